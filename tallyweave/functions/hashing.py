"""Portable hashing as pure Column arithmetic.

A key is cut into three short integer lanes, combined linearly modulo the prime 2^31 - 1 and
passed through a cubic polynomial. All products stay below 2^62, so BIGINT never overflows,
nothing leaves whole-stage codegen, and any SQL engine computes the same values: ``HashFn.sql``
renders the identical arithmetic as text for the oracles.

From one value ``h`` in [0, 2^31 - 1) an operator takes a sign (lowest bit), a cell
(``(h >> 1) % width``) or a sampling depth (number of trailing one bits).
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647
LANE_MASK = 268435455  # 28 bits
LANES = ("_l0", "_l1", "_l2")
TEXT_LANES = ((1, 7), (8, 7), (15, 2))  # start and length in the md5 of a text key


@dataclass(frozen=True)
class HashFn:
    """Coefficients of one hash function: a linear part over the lanes, then a cubic."""

    a0: int
    a1: int
    a2: int
    b: int
    c0: int
    c1: int
    c2: int
    c3: int

    def coefficients(self) -> tuple[int, ...]:
        return (self.a0, self.a1, self.a2, self.b, self.c0, self.c1, self.c2, self.c3)

    def column(self, lanes: Sequence[Column]) -> Column:
        c = self.coefficients()
        return cubic_part(linear_part(lanes, c), c)

    def sql(self, lanes: Sequence[str]) -> str:
        return mix_sql(lanes, [f"{c}::BIGINT" for c in self.coefficients()])


def hash_fn(seed: int, role: str, level: int = 0, row: int = 0) -> HashFn:
    """The hash function of one (seed, role, level, row)."""
    rng = random.Random(f"{seed}/{role}/{level}/{row}")
    return HashFn(*(rng.randrange(1, PRIME) for _ in range(8)))


def linear_part(lanes: Sequence[Column], coef: Sequence) -> Column:
    """Coefficients are ints or BIGINT columns; lanes are BIGINT, so products are too."""
    return (lanes[0] * coef[0] + lanes[1] * coef[1] + lanes[2] * coef[2] + coef[3]) % PRIME


def cubic_part(x: Column, coef: Sequence) -> Column:
    return (((x * coef[7] + coef[6]) % PRIME * x + coef[5]) % PRIME * x + coef[4]) % PRIME


def with_lanes(df: DataFrame, text: bool) -> DataFrame:
    """Adds the lanes of ``key`` as columns, to be shared by several hashes."""
    if text:
        parts = [f"CAST(conv(substring(md5(CAST(key AS BINARY)), {start}, {size}), 16, 10) AS BIGINT)"
                 for start, size in TEXT_LANES]
    else:
        k = "CAST(key AS BIGINT)"
        parts = [f"{k} & {LANE_MASK}", f"shiftright({k}, 28) & {LANE_MASK}", f"shiftright({k}, 56) & 255"]
    return df.selectExpr("*", *[f"{e} AS {n}" for e, n in zip(parts, LANES)])


def with_hashes(df: DataFrame, fns: dict[str, Sequence]) -> DataFrame:
    """Adds one hash column per entry to a table that has lanes.

    Coefficients are ints or SQL text. The linear part is a projection of its own: it is used
    three times, and the optimizer keeps such projections apart, so it is computed once. Both
    steps are SQL text because one parsed expression is far cheaper to build than a tree of
    Column calls.
    """
    l0, l1, l2 = LANES
    linear = lambda c: f"({l0} * {c[0]} + {l1} * {c[1]} + {l2} * {c[2]} + {c[3]}) % {PRIME}"
    cubic = lambda x, c: f"((({x} * {c[7]} + {c[6]}) % {PRIME} * {x} + {c[5]}) % {PRIME} * {x} + {c[4]}) % {PRIME}"
    staged = df.selectExpr("*", *[f"{linear(c)} AS _x{n}" for n, c in fns.items()])
    names = [f"`{c}`" for c in df.columns]
    return staged.selectExpr(*names, *[f"{cubic(f'_x{n}', c)} AS {n}" for n, c in fns.items()])


def cell_text(h: str, width: int | str) -> str:
    return f"(shiftright({h}, 1) % {width})"


def sign_text(h: str) -> str:
    return f"(1 - 2 * ({h} % 2))"


def mix_sql(lanes: Sequence[str], coef: Sequence[str]) -> str:
    a0, a1, a2, b, c0, c1, c2, c3 = coef
    x = f"(({a0}*{lanes[0]} + {a1}*{lanes[1]} + {a2}*{lanes[2]} + {b}) % {PRIME})"
    return f"(((({c3}*{x} + {c2}) % {PRIME} * {x} + {c1}) % {PRIME} * {x} + {c0}) % {PRIME})"


def lanes(key: Column, text: bool = False) -> tuple[Column, Column, Column]:
    """Three non-negative lanes of a BIGINT key, or of the md5 of a text key."""
    if text:
        digest = F.md5(key.cast("binary"))
        return tuple(
            F.conv(F.substring(digest, start, size), 16, 10).cast("bigint")
            for start, size in TEXT_LANES
        )
    k = key.cast("bigint")
    mask = F.lit(LANE_MASK).cast("bigint")
    return (
        k.bitwiseAND(mask),
        F.shiftright(k, 28).bitwiseAND(mask),
        F.shiftright(k, 56).bitwiseAND(F.lit(255).cast("bigint")),
    )


def lanes_sql(key: str, text: bool = False) -> tuple[str, str, str]:
    if text:
        return tuple(
            f"(('0x' || substring(md5({key}), {start}, {size}))::BIGINT)"
            for start, size in TEXT_LANES
        )
    return (
        f"({key} & {LANE_MASK})",
        f"(({key} >> 28) & {LANE_MASK})",
        f"(({key} >> 56) & 255)",
    )


def hash_value(key: Column, seed: int, role: str, level: int = 0, row: int = 0,
               text: bool = False) -> Column:
    return hash_fn(seed, role, level, row).column(lanes(key, text))


def cell_of(h: Column, width: int) -> Column:
    return F.shiftright(h, 1) % width


def sign_of(h: Column) -> Column:
    return 1 - (h % 2) * 2


def depth_text(h: str, levels: int) -> str:
    """Deepest level a key is sampled into: its number of trailing one bits, capped."""
    return f"least(bit_count({h} ^ ({h} + 1)) - 1, {levels - 1})"


def hash_bucket(key: Column, seed: int, width: int, role: str = "bucket", level: int = 0,
                row: int = 0, text: bool = False) -> Column:
    return cell_of(hash_value(key, seed, role, level, row, text), width)


def hash_sign(key: Column, seed: int, role: str = "sign", level: int = 0, row: int = 0,
              text: bool = False) -> Column:
    return sign_of(hash_value(key, seed, role, level, row, text))


def hash_bit(key: Column, seed: int, role: str = "bit", level: int = 0, row: int = 0,
             text: bool = False) -> Column:
    return hash_value(key, seed, role, level, row, text) % 2


def hash_two_universal(key: Column, seed: int, width: int, text: bool = False) -> Column:
    """Linear hash of the lanes only (2-universal, cheaper than the cubic)."""
    f = hash_fn(seed, "linear")
    l0, l1, l2 = lanes(key, text)
    return linear_part((l0, l1, l2), f.coefficients()) % width


def uniform_from_seed(key: Column, seed: int, text: bool = False) -> Column:
    """Reproducible uniform in the open interval (0, 1), one per key."""
    h = hash_value(key, seed, "uniform", text=text)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(PRIME))


def coefficients_at(fns: Sequence[HashFn], position: str) -> list[str]:
    """Coefficients, as SQL text, of the function at ``position``: one literal array each."""
    return [f"get(array({','.join(f'{c}L' for c in column)}), {position})"
            for column in zip(*(f.coefficients() for f in fns))]
