"""Column helpers that the operators and the dump format need; all stay in the JVM."""

from __future__ import annotations

import resource
import sys
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from phraseloom.schemas import EOS_VID


def with_eos(toks: Column) -> Column:
    """The tokens and the end-of-sentence token that is implied after them."""
    return F.concat(toks, F.array(F.lit(EOS_VID)))


def token_at(toks: Column, i: Column) -> Column:
    """Token ``i``; the index one past the last gives the end of sentence, any other outside index null."""
    return F.when(i == F.size(toks), F.lit(EOS_VID)).when((i >= 0) & (i < F.size(toks)), F.get(toks, i))


def hex8(vid: Column) -> Column:
    return F.lower(F.lpad(F.hex(vid.cast("bigint")), 8, "0"))


def child_path(vid: Column) -> Column:
    """Two-level directory of a child node: the first five hex digits, then all eight."""
    return F.concat(F.substring(hex8(vid), 1, 5), F.lit("/"), hex8(vid))


def nspaces(n: Column) -> Column:
    return F.repeat(F.lit(" "), n)


def skip_spaces(text: Column) -> Column:
    return F.ltrim(text)


def format_time(seconds: Column) -> Column:
    return F.format_string("%.6f", seconds)


def suffix_precedes(this: Column, other: Column) -> Column:
    """``other < this`` on suffixes, shorter first: the sense in which positions are compared."""
    return other < this


def benchmark_time(body: Callable[[], object], name: str) -> float:
    """Run ``body``, print '<name> time = <s> s' to stderr and return the seconds."""
    began = time.perf_counter()
    body()
    took = time.perf_counter() - began
    print(f"{name} time = {took:.6f} s", file=sys.stderr)
    return took


def usage() -> dict[str, float]:
    """CPU seconds and peak resident MB of the driver's Python."""
    r = resource.getrusage(resource.RUSAGE_SELF)
    return {"cpu_s": r.ru_utime + r.ru_stime, "wall_s": time.monotonic(), "rss_max_mb": r.ru_maxrss / 1024}
