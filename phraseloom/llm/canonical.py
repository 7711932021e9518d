"""One consistent form for visually identical text: DuckDB inside Arrow partitions.

Every Arrow batch goes through embedded SQL on a single-threaded in-memory DuckDB.  Texts without a character above U+007F
pass untouched.  In the others, in this order: characters that Unicode calls ignorable go, space characters become
U+0020, compatibility forms (full-width, half-width, circled, styled, superscript, ligatures ..) become the letters, digits
or marks that they stand for, the text is composed (NFC), words that mix Latin, Cyrillic and Greek letters are brought
to the script that most of their letters allow, and what that left is composed again.  Texts that changed go through
again until they don't, so the form of a form is itself.

A word written wholly in another script's look-alikes is not mixed, and which script was meant cannot be told from the
word.  Its text stays; the comparison key that comes with each text folds look-alikes and case, so such words are
equal there.  Null text stays null, empty text stays empty; no text is cut.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Unicode code points.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
WIDE_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Ranges of code points that Unicode lists as default-ignorable and that have no look of their own in running text.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF),
]
# Letters that look alike.  Each row: Latin, Cyrillic, Greek ('' where the script has no such letter).
LOOKALIKES = [
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", ""), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"), ("J", "Ј", ""),
    ("K", "К", "Κ"), ("M", "М", "Μ"), ("N", "", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"), ("S", "Ѕ", ""), ("T", "Т", "Τ"),
    ("X", "Х", "Χ"), ("Y", "У", "Υ"), ("Z", "", "Ζ"),
    ("a", "а", "α"), ("c", "с", ""), ("e", "е", ""), ("i", "і", "ι"), ("j", "ј", ""), ("k", "к", "κ"), ("o", "о", "ο"),
    ("p", "р", "ρ"), ("s", "ѕ", ""), ("u", "", "υ"), ("v", "", "ν"), ("x", "х", "χ"), ("y", "у", ""), ("ë", "ё", ""), ("ï", "ї", ""),
]


def _compatible() -> dict[str, str]:
    """Compatibility forms by rule: what Unicode's compatibility mapping makes of a character, where a letter or digit stays
    letters and digits, and a mark or symbol stays marks and symbols (so no sign turns into a word)."""
    out = {}
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x20000)]):
        if not unicodedata.decomposition(c).startswith("<"):
            continue
        to, word = unicodedata.normalize("NFKC", c), unicodedata.category(c)[0] in "LN"
        if to != c and all(unicodedata.category(x)[0] in ("LNM" if word else "PS") for x in to):
            out[c] = to
    return out


COMPAT = _compatible()
_MANY = {c: to for c, to in COMPAT.items() if len(to) > 1}


def _ranges(chars: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted(chars):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def _span_class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def _folding() -> tuple[str, str]:
    """Lower-case letters and the Latin ones that they look like, themselves or as capitals; the small letter's look counts first."""
    fold: dict[str, str] = {}
    for row in sorted(LOOKALIKES, key=lambda r: (r[0] or r[1]).isupper()):
        for c in row[1:]:
            if c and row[0] and len(c.lower()) == 1:
                fold.setdefault(c.lower(), row[0].lower())
    return "".join(fold), "".join(fold.values())


FOLD = _folding()


def _pairs(of: int, to: int) -> tuple[str, str]:
    rows = [r for r in LOOKALIKES if r[of] and r[to]]
    return "".join(r[of] for r in rows), "".join(r[to] for r in rows)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def _translate(expr: str, of: str, to: str) -> str:
    return f"translate({expr}, {_quoted(of)}, {_quoted(to)})"


_SCRIPTS = ("Latin", "Cyrillic", "Greek")
MIXED = "|".join("\\p{%s}\\p{L}*[%s]" % (s, "".join("\\p{%s}" % o for o in _SCRIPTS if o != s)) for s in _SCRIPTS)
NON_ASCII = "[^\\x00-\\x7F]"

def _to_script(word: str, script: int) -> str:
    for other in range(3):
        if other != script:
            word = _translate(word, *_pairs(other, script))
    return word


def _count(word: str, script: str) -> str:
    return f"len(regexp_replace({word}, '[^\\p{{{script}}}]', '', 'g'))"


def _foreign(word: str, script: int) -> str:
    """Letters of other scripts that stay when a word is brought to a script."""
    others = "".join("\\p{%s}" % o for i, o in enumerate(_SCRIPTS) if i != script)
    return f"len(regexp_replace({_to_script(word, script)}, '[^{others}]', '', 'g'))"


def _unmixed(word: str) -> str:
    """The script that leaves fewest letters of others wins, then the one with most letters, then Latin, Cyrillic, Greek."""
    score = [f"({_count(word, s)} - {_foreign(word, i)} * 100000)" for i, s in enumerate(_SCRIPTS)]
    return (
        f"case when {score[1]} > {score[0]} and {score[1]} >= {score[2]} then {_to_script(word, 1)} "
        f"when {score[2]} > {score[0]} then {_to_script(word, 2)} else {_to_script(word, 0)} end"
    )


def _macros() -> list[str]:
    ignorable = _span_class(IGNORABLE)
    odd = _span_class(sorted([*IGNORABLE, *_ranges([ord(c) for c in SPACES]), *_ranges([ord(c) for c in COMPAT])]))
    pairs = "[" + ", ".join(_quoted(c + to) for c, to in _MANY.items()) + "]"
    # Spaces and full-width forms are frequent; the long table of the others is read only where one of them stands.
    plain = _translate(f"regexp_replace(t, '{ignorable}', '', 'g')", WIDE + SPACES, WIDE_PLAIN + " " * len(SPACES))
    rest = {c: to for c, to in COMPAT.items() if c not in WIDE}
    one = {c: to for c, to in rest.items() if len(to) == 1}
    return [
        f"create macro is_plain(t) as not regexp_matches(t, '{NON_ASCII}')",
        f"create macro has_mixed(t) as regexp_matches(t, '{MIXED}')",
        # What may differ between equal-looking texts, apart from look-alikes; most texts with accents have none of it.
        f"create macro has_odd(t) as regexp_matches(t, '{odd}')",
        f"create macro has_rest(t) as regexp_matches(t, '{_span_class(_ranges([ord(c) for c in rest]))}')",
        f"create macro has_many(t) as regexp_matches(t, '{_span_class(_ranges([ord(c) for c in _MANY]))}')",
        # Each pair is a character and what it becomes.
        f"create macro spelled(t) as case when has_many(t) then list_reduce(list_prepend(t, {pairs}), lambda a, x: replace(a, left(x, 1), substr(x, 2))) else t end",
        f"create macro has_marked(t) as regexp_matches(t, '{_class(INVISIBLE)}|[\\x{{FF01}}-\\x{{FF5E}}]')",
        # Blocks without combining marks and without characters that composition replaces need no look-up.
        "create macro may_compose(t) as regexp_matches(t, '[^\\x00-\\x{2FF}\\x{370}-\\x{373}\\x{388}-\\x{482}\\x{48A}-\\x{52F}\\x{2010}-\\x{2027}]')",
        "create macro composed(t) as case when may_compose(t) then nfc_normalize(t) else t end",
        f"create macro stripped(t) as case when has_odd(t) then {plain} else t end",
        f"create macro narrowed(t) as case when has_rest(t) then spelled({_translate('t', ''.join(one), ''.join(one.values()))}) else t end",
        f"create macro unmixed_word(w) as case when has_mixed(w) then {_unmixed('w')} else w end",
        "create macro unmixed(t) as case when has_mixed(t) then array_to_string(list_transform(regexp_extract_all(t, '\\p{L}+|\\P{L}+'), lambda w: unmixed_word(w)), '') else t end",
        f"create macro comparable(t) as {_translate('lower(t)', *FOLD)}",
        f"""create macro forms(t) as case when is_plain(t) then null else list_filter([
            case when regexp_matches(t, '[\\x{{FF01}}-\\x{{FF5E}}]') then 'wide' end,
            case when may_compose(t) and nfc_normalize(t) <> t then 'combining' end,
            case when regexp_matches(t, '{_class(INVISIBLE)}') then 'invisible' end,
            case when regexp_matches(t, '{_class(SPACES)}') then 'space' end,
            case when has_mixed(composed(case when has_marked(t) then {_translate(f"regexp_replace(t, '{_class(INVISIBLE)}', '', 'g')", WIDE, WIDE_PLAIN)} else t end)) then 'lookalike' end],
            lambda f: f is not null) end""",
    ]


# One step a subquery: nested in one expression, each macro would repeat the text of those below it several times.
_STEPS = ("stripped", "narrowed", "composed", "unmixed", "composed")
_FORM = "select i, t, is_plain(t) as plain, t as c from b"
for _step in _STEPS:
    _FORM = f"select i, t, plain, case when plain then c else {_step}(c) end as c from ({_FORM})"


class Canonicaliser:
    """A worker's DuckDB with the macros of this module."""

    def __init__(self) -> None:
        self.con = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "400MB"})
        for m in _macros():
            self.con.execute(m)

    def query(self, batch: pa.RecordBatch | pa.Table, sql: str) -> pa.Table:
        """Run ``sql`` over the batch as view ``b``."""
        self.con.register("b", batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch]))
        try:
            got = self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister("b")
        return got

    def canonical(self, col: pa.Array) -> pa.Array:
        """The form of each text; texts that change are formed again until they don't."""
        out, at, now = None, None, pa.table({"i": pa.array(range(len(col)), pa.int64()), "t": col.cast(pa.string())})
        while True:
            got = self.query(now, f"select i, c, coalesce(c <> t, false) as moved from ({_FORM}) order by i").combine_chunks()
            out = got["c"].combine_chunks() if out is None else pc.replace_with_mask(out, at, got["c"].combine_chunks())
            if not pc.any(got["moved"]).as_py():
                return out
            some = got.filter(got["moved"])
            at = pc.is_in(pa.array(range(len(col)), pa.int64()), some["i"].combine_chunks())
            now = some.select(["i", "c"]).rename_columns(["i", "t"])

    def texts(self, texts: list[str | None]) -> list[str | None]:
        return self.canonical(pa.array(texts, pa.string())).to_pylist()


def _embedded(sql: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = None
        for batch in batches:
            if not batch.num_rows:
                continue
            canon = canon or Canonicaliser()
            yield from canon.query(batch, sql).cast(schema).to_batches()

    return run


def canonical_texts(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``id_col, text, key, changed``: the form of every row's text and its comparison key, one row per input row.

    ``key`` is the form without case and with look-alike letters folded.  Null text gives a null form that isn't changed.
    Other columns are pruned before the scan, whatever their names.
    """
    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("changed", T.BooleanType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = None
        for batch in batches:
            if batch.num_rows:
                canon = canon or Canonicaliser()
                form = canon.canonical(batch.column("t"))
                rows = pa.table({"id": batch.column("id"), "t": batch.column("t"), "c": form})
                yield from canon.query(rows, "select id, c as text, comparable(c) as key, coalesce(c <> t, false) as changed from b").cast(arrow).to_batches()

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("t"))
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def text_forms(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``id_col, form``: one row for each kind of odd writing that a row's text holds; repeated rows give repeated results."""
    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("form", T.StringType())])
    sql = "select id, unnest(f) as form from (select id, forms(t) as f from b where t is not null) where len(f) > 0"
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("t"))
    return rows.mapInArrow(_embedded(sql, to_arrow_schema(out)), out).withColumnRenamed("id", id_col)
