"""Sums of doubles that do not depend on their order: every double is cut into whole numbers that add without loss."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# bits of a part: a sum of 2**34 parts still fits a long
BITS = 28
MASK = (1 << BITS) - 1
LOWEST = -1074
# more parts than this are added up in an array
FEW = 8


def _scaled(c: Column, exponent: int) -> Column:
    """``c * 2**exponent``; two steps where the power itself is no double."""
    half = exponent // 2 if abs(exponent) > 1000 else 0
    c = c * F.lit(math.ldexp(1.0, half)) if half else c
    return c * F.lit(math.ldexp(1.0, exponent - half))


@dataclass(frozen=True)
class ExactSum:
    """Parts of doubles in units of ``2**(low + 28 * k)``. ``odd`` if there are infinities or NaN: they are counted."""

    low: int = 0
    size: int = 1
    odd: bool = False

    @classmethod
    def of(cls, df: DataFrame, amount: Column) -> ExactSum:
        """Enough parts for all amounts of ``df``; more parts would give the same sums."""
        x = F.abs(amount.cast("double"))
        finite = x < F.lit(float("inf"))
        least, most, odd = df.agg(
            F.min(F.when(finite & (x > 0), x)), F.max(F.when(finite, x)), F.count_if(~finite)
        ).first()
        if not most:
            return cls(odd=odd > 0)
        low = max(LOWEST, math.frexp(least)[1] - 53)
        return cls(low, math.ceil((math.frexp(most)[1] - low) / BITS), odd > 0)

    def parts(self, amount: Column) -> list[Column]:
        """Whole numbers, null for a null amount. Each is the rest that the coarser roundings leave, and so exact."""
        x = amount.cast("double")
        finite = F.abs(x) < F.lit(float("inf"))

        def rounded(k: int) -> Column:
            return F.rint(_scaled(x, -(self.low + BITS * k)))

        out = []
        for k in range(self.size):
            part = rounded(k)
            if k + 1 < self.size:
                part = part - rounded(k + 1) * F.lit(float(1 << BITS))
            # the lowest bit of a larger double is above this part
            limit = self.low + BITS * (k + 1) + 53
            small = F.abs(x) < F.lit(math.ldexp(1.0, limit) if limit < 1024 else float("inf"))
            out.append(F.when(small, part.cast("long")).when(x.isNotNull(), F.lit(0).cast("long")))
        if self.odd:
            signs = (x == F.lit(float("inf")), x == F.lit(float("-inf")), F.isnan(x))
            out = [F.when(finite, part).when(x.isNotNull(), F.lit(0).cast("long")) for part in out]
            out += [F.when(x.isNotNull(), sign.cast("long")) for sign in signs]
        return out

    def total(self, sums: list[Column]) -> Column:
        """The double of summed parts: carries go up first, then the digits are added from the highest one down."""
        if self.size > FEW:
            return self._finite_or_not(self._total_of_many(sums[:self.size]), sums)
        digits, carried = [], sums[0]
        for k in range(1, self.size):
            digits.append(carried.bitwiseAND(F.lit(MASK)))
            carried = sums[k] + F.shiftright(carried, BITS)
        digits.append(carried)
        out = F.lit(0.0)
        for k in reversed(range(self.size)):
            out = out + _scaled(digits[k].cast("double"), self.low + BITS * k)
        return self._finite_or_not(out, sums)

    def _total_of_many(self, sums: list[Column]) -> Column:
        """The same as an array of digits, highest first, whose expression does not grow with the square of the parts."""
        zero = F.lit(0).cast("long")
        state = F.struct(zero.alias("carry"), F.array().cast("array<long>").alias("digits"))

        def step(acc: Column, part: Column) -> Column:
            carried = part + acc["carry"]
            return F.struct(
                F.shiftright(carried, BITS).alias("carry"),
                F.concat(F.array(carried.bitwiseAND(F.lit(MASK))), acc["digits"]).alias("digits"))

        # the carry of the highest part stays with it, as it has no part above
        units = F.array(*[F.struct(F.lit(math.ldexp(1.0, (e := self.low + BITS * k) - e // 2)).alias("a"), F.lit(math.ldexp(1.0, e // 2)).alias("b")) for k in reversed(range(self.size))])
        done = F.aggregate(F.array(*sums[:-1]), state, step)
        digits = F.concat(F.array(sums[-1] + done["carry"]), done["digits"])
        return F.aggregate(
            F.zip_with(digits, units, lambda d, u: d.cast("double") * u["a"] * u["b"]), F.lit(0.0), lambda acc, x: acc + x)

    def _finite_or_not(self, out: Column, sums: list[Column]) -> Column:
        if self.odd:
            up, down, no = sums[self.size:]
            out = (
                F.when((no > 0) | ((up > 0) & (down > 0)), F.lit(float("nan")))
                .when(up > 0, F.lit(float("inf"))).when(down > 0, F.lit(float("-inf"))).otherwise(out)
            )
        return out
