"""Binomial tails in log space, and numbers with a separate exponent.

Probabilities go far below what a double holds, so everything is ln(probability).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def ln_choose(n: int) -> list[float]:
    facts = [0.0]
    for i in range(1, n + 1):
        facts.append(facts[-1] + math.log(i))
    return [facts[n] - facts[j] - facts[n - j] for j in range(n + 1)]


def ln_tail(p: Column, x: Column, trials: int, zero_sorts_last: bool = True) -> Column:
    """ln P(X > x) for X ~ Binomial(trials, p), 0 < p < 1, without user functions.

    For x >= trials the tail is zero. With ``zero_sorts_last`` that zero counts as
    probability one, so it never wins and never passes a cutoff; else it is -infinity.
    """
    choose = F.array(*map(F.lit, ln_choose(trials)))
    term = lambda j: F.get(choose, j.cast("int")) + j * F.log(p) + (trials - j) * F.log1p(-p)
    terms = F.transform(F.sequence(x.cast("int") + 1, F.lit(trials)), term)
    total = lambda t: F.array_max(t) + F.log(F.aggregate(F.transform(t, lambda v: F.exp(v - F.array_max(t))), F.lit(0.0), lambda a, v: a + v))
    once = F.get(F.transform(F.array(terms), total), F.lit(0))
    return F.when(x >= trials, F.lit(0.0 if zero_sorts_last else -math.inf)).otherwise(once)


def smallest_significant(p: Column, trials: int, exponent: int) -> Column:
    """The least x with P(X > x) < 10^-exponent, taking the zero at ``trials`` as zero."""
    every = F.sequence(F.lit(0), F.lit(trials))
    passing = F.filter(every, lambda x: ln_tail(p, x, trials, zero_sorts_last=False) < -exponent * math.log(10))
    return F.array_min(passing)


def ln_gamma_int(n: Column) -> Column:
    """ln (n - 1)! for integers n >= 1."""
    return F.aggregate(F.when(n > 2, F.sequence(F.lit(2).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, j: a + F.log(j.cast("double")))


def _ln_gamma(x):
    """ln |gamma(x)| of an array: Stirling's series from 10 on, to which smaller values are shifted; reflected below a half."""
    import numpy as np

    below = x < 0.5
    y = np.where(below, 1 - x, x)
    shift, product = y.copy(), np.ones_like(y)
    for _ in range(10):
        small = shift < 10
        product = np.where(small, product * shift, product)
        shift = np.where(small, shift + 1, shift)
    inverse = 1 / shift
    series = 0.0
    for b, n in reversed(((1 / 6, 2), (-1 / 30, 4), (1 / 42, 6), (-1 / 30, 8), (5 / 66, 10), (-691 / 2730, 12), (7 / 6, 14))):  # Bernoulli numbers
        series = series * inverse * inverse + b / (n * (n - 1))
    found = (shift - 0.5) * np.log(shift) - shift + 0.5 * math.log(2 * math.pi) + series * inverse - np.log(product)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(below, math.log(math.pi) - np.log(np.abs(np.sin(np.pi * x))) - found, found)


@pandas_udf(T.DoubleType())
def ln_gamma(values: pd.Series) -> pd.Series:
    """ln |gamma(x)| of real x, null for null; Spark SQL has no such function."""
    return pd.Series(_ln_gamma(values.to_numpy(float)))


def _incomplete_beta(a, b, x):
    """I_x(a, b) of arrays by a continued fraction, on the side where it converges fast."""
    import numpy as np

    if not (np.all(a > 0) and np.all(b > 0) and np.all((x >= 0) & (x <= 1))):
        raise ValueError("a and b must be positive and x between 0 and 1")
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b) + a * np.log(inner) + b * np.log1p(-inner)) / a
    tiny = 1e-300
    value, c, d = np.ones_like(x), np.ones_like(x), np.zeros_like(x)  # modified Lentz: value is the product of the ratios c * d
    for i in range(400):
        m = i // 2
        step = np.ones_like(x) if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + step * d
        d = 1 / np.where(d == 0, tiny, d)
        c = 1 + step / c
        c = np.where(c == 0, tiny, c)
        value *= c * d
        if i and np.all(np.abs(c * d - 1) < 1e-15):
            break
    found = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * (value - 1)))
    return np.where(flip, 1 - found, found)


@pandas_udf(T.DoubleType())
def regularized_beta(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """I_x(a, b), the regularized incomplete beta function."""
    for a, b, x in parts:
        yield pd.Series(_incomplete_beta(*(v.to_numpy(float) for v in (a, b, x))))


def big_exp(value: Column) -> Column:
    """``struct<exp, mant>`` with value = mant * 2^exp and 1 <= |mant| < 2; zero is (0, 0)."""
    guess = F.floor(F.log2(F.abs(value))).cast("int")
    scaled = F.abs(value) / F.pow(F.lit(2.0), guess)
    exp = F.when(scaled >= 2, guess + 1).when(scaled < 1, guess - 1).otherwise(guess)
    return F.when(value == 0, F.struct(F.lit(0).alias("exp"), F.lit(0.0).alias("mant"))).otherwise(F.struct(exp.alias("exp"), (value / F.pow(F.lit(2.0), exp)).alias("mant")))


def by_rounded_log2(big: Column) -> Column:
    """The same number with the exponent floor(log2 |value|) as doubles have it.

    Just below a power of two the logarithm rounds up to a whole number, so the mantissa is just below 1 there.
    """
    step = F.log1p((F.abs(big["mant"]) - 2) / 2) / math.log(2)  # from the next power, without cancellation
    up = ((big["exp"] + 1) + step == (big["exp"] + 1)) & (big["mant"] != 0)
    return F.when(up, F.struct((big["exp"] + 1).alias("exp"), (big["mant"] / 2).alias("mant"))).otherwise(big)


def big_from_ln(ln: Column) -> Column:
    """The same struct from ln(value), for values that a double cannot hold."""
    exp = F.floor(ln / math.log(2)).cast("int")
    return F.struct(exp.alias("exp"), F.exp(ln - exp * math.log(2)).alias("mant"))


def ln_of_big(big: Column) -> Column:
    return F.when(big["mant"] == 0, F.lit(-math.inf)).otherwise(F.log(big["mant"]) + big["exp"] * math.log(2))


def as_double(big: Column) -> Column:
    return big["mant"] * F.pow(F.lit(2.0), big["exp"])


def ln_multiply(a: Column, b: Column) -> Column:
    return a + b


def ln_divide(a: Column, b: Column) -> Column:
    return a - b


def ln_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def ln_subtract(a: Column, b: Column) -> Column:
    """ln(e^a - e^b) for a > b."""
    return a + F.log1p(-F.exp(b - a))


def big_exp_of(big: Column) -> Column:
    """e to the power of a number; the result may lie beyond doubles, the exponent must not."""
    return big_from_ln(as_double(big))


def big_power(big: Column, power: Column | float) -> Column:
    """A number above zero to any power; zero stays zero for powers above zero."""
    zero = F.struct(F.lit(0).alias("exp"), F.lit(0.0).alias("mant"))
    return F.when(big["mant"] == 0, zero).otherwise(big_from_ln(ln_of_big(big) * power))


def big_sqrt(big: Column) -> Column:
    """The square root; an odd exponent lends one to the mantissa, so nothing is rounded twice."""
    odd = F.pmod(big["exp"], F.lit(2))
    root = F.struct(F.floor(big["exp"] / 2).cast("int").alias("exp"), F.sqrt(big["mant"] * (odd + 1)).alias("mant"))
    return F.when(big["mant"] == 0, F.struct(F.lit(0).alias("exp"), F.lit(0.0).alias("mant"))).otherwise(root)


def big_square(big: Column) -> Column:
    mant = big["mant"] * big["mant"]
    over = (mant >= 2).cast("int")
    return F.struct((big["exp"] * 2 + over).alias("exp"), (mant / (over + 1)).alias("mant"))


def big_less(a: Column, b: Column) -> Column:
    """Exponents are compared first, then mantissas; so zero, whose exponent is 0, is not the least."""
    return (a["exp"] < b["exp"]) | ((a["exp"] == b["exp"]) & (a["mant"] < b["mant"]))
