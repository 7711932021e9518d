"""One-by-one insertion into a hybrid trie, as a check on the closed form and on the suffix order."""

EOS = 1


class Node:
    def __init__(self):
        self.array, self.children = [], None

    def size(self):
        return len(self.array) if self.children is None else sum(c.size() for c in self.children.values())


def key(sents, pos):
    sid, off = pos
    return sents[sid][off:]


def build(sents, max_leaf, preload=None):
    root = Node()
    if preload:
        root.array = sorted(((s, o) for s in preload for o in range(len(sents[s]))), key=lambda p: (key(sents, p), p))
    for sid in sorted(sents):
        if preload and sid in preload:
            continue
        for off in range(len(sents[sid])):
            node, depth = root, 0
            full = sents[sid][off:] + [EOS]
            while node.children is not None:
                node = node.children.setdefault(full[depth], Node())
                depth += 1
            at = sum(1 for p in node.array if key(sents, p) <= key(sents, (sid, off)))
            node.array.insert(at, (sid, off))
            ended = depth and full[depth - 1] == EOS
            if len(node.array) > max_leaf and not ended:
                node.children = {}
                for p in node.array:
                    v = (key(sents, p) + [EOS])[depth]
                    node.children.setdefault(v, Node()).array.append(p)
                node.array = []
    return root


def shape(node, path=()):
    yield path, node.size(), node.children is None
    for v in sorted(node.children or {}):
        yield from shape(node.children[v], (*path, v))


def flat(node):
    if node.children is None:
        yield from node.array
    for v in sorted(node.children or {}):
        yield from flat(node.children[v])


def dump(node, words, depth=0):
    pad = " " * (2 * depth)
    yield f"{pad}TreeNode size={node.size()} is_leaf={'true' if node.children is None else 'false'}"
    for v in sorted(node.children or {}):
        yield f"{pad}* '{words[v]}' vid={v}"
        yield from dump(node.children[v], words, depth + 1)
    for s, o in node.array:
        yield f"{pad}* [sid={s} offset={o}]"
