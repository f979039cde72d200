"""Counter-based random draws.

A draw is a pure function of its coordinates, so results do not depend on partitioning,
task retries or executor loss (unlike `rand()`):

    u = int(first 8 hex digits of md5(seed|config|split|dialogue|copy|turn|token|purpose)) / 2^32

`u` is a multiple of 2^-32 in [0, 1), so `u * k` is exact in double precision for small k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def uniform(*parts: Column | str | int) -> Column:
    """Uniform [0, 1) draw from the md5 of the '|'-joined string forms of `parts`.

    Columns are cast to string; Python values are literals (a `str` is text, not a name).
    """
    strs = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    h = F.substring(F.md5(F.concat_ws("|", *strs)), 1, 8)
    return F.conv(h, 16, 10).cast("bigint").cast("double") / F.lit(TWO_POW_32)


def draw_key(*parts: Column | str | int) -> Column:
    """The parts of a draw that a row's draws have in common, joined (null parts are left out).  As a column of its own it is
    joined once a row, in generated code; the folds of a row append to it."""
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def key_digits(key: Column, i: Column, purpose: str) -> Column:
    """The digits of the draw of `uniform` for the parts of `key`, i and the purpose."""
    return F.substring(F.md5(F.concat(key, F.lit("|"), i.cast("string"), F.lit("|" + purpose))), 1, 8)


def uniform_blocks(items: Column | str, key: Column, purpose: str) -> Column:
    """Digests for the draws of an array's items, four draws each: element b is the md5 of the
    key (`draw_key`), b and the purpose; `block_draw` reads item i's digits from element i div 4."""
    n = F.size(items)
    return F.when(n > 0, F.transform(
        F.sequence(F.lit(0), F.shiftright(n - 1, 2)),
        lambda b: F.md5(F.concat(key, F.lit("|"), b.cast("string"), F.lit("|" + purpose)))))


def block_digits(digests: Column, i: Column) -> Column:
    """The digits of item i's draw: eight of the 32 of its block's digest.  They order as the draws do."""
    return F.substr(digests[F.shiftright(i, 2)], F.shiftleft(i.bitwiseAND(F.lit(3)), 3) + 1, F.lit(8))


def digits_draw(digits: Column) -> Column:
    """Uniform [0, 1) draw of eight hexadecimal digits."""
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(TWO_POW_32)


def block_draw(digests: Column, i: Column) -> Column:
    """Uniform [0, 1) draw of item i."""
    return digits_draw(block_digits(digests, i))


def least_digits(reached: Callable[[float], bool]) -> str | None:
    """The digits of the smallest draw for which `reached` holds (it stays true from there on); None without one."""
    lo, hi = 0, 1 << 32
    while lo < hi:
        mid = (lo + hi) // 2
        if reached(mid / TWO_POW_32):
            hi = mid
        else:
            lo = mid + 1
    return f"{lo:08x}" if lo < 1 << 32 else None


def pick_index(u: Column, n: Column | int) -> Column:
    """0-based index of a uniform choice among n items (n > 0)."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.floor(u * n_col).cast("int")


def pick_bounds(n: int) -> list[str]:
    """The digits from which on `pick_index` is 1, 2, ... n - 1."""
    return [least_digits(lambda u, k=k: int(u * n) >= k) for k in range(1, n)]
