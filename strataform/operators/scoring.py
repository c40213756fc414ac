"""Composite scores, curves, CRITIC weights and status resolution."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import ROUND_HALF_EVEN, Decimal, localcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strataform.functions.rounding import half_even

#: Metres and score of the road curve, linear between them.
ROAD_CURVE = [(0, 100), (250, 100), (1000, 70), (3000, 20), (5000, 0)]


def curve(x: Column, points: list[tuple[int, int]] = ROAD_CURVE) -> Column:
    """Piecewise linear in exact decimals; null for null, the last score beyond the last point."""
    d = x.cast("decimal(18,6)")
    out = F.lit(points[-1][1]).cast("decimal(18,6)")
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        line = F.lit(y0) + (d - x0) * F.lit(y1 - y0) / F.lit(x1 - x0)
        out = F.when(d <= x1, line.cast("decimal(18,6)")).otherwise(out)
    out = F.when(d <= points[0][0], F.lit(points[0][1]).cast("decimal(18,6)")).otherwise(out)
    return half_even(F.when(x.isNotNull(), out), 4, 9)


def weight_fault(text: Column, keys: tuple[str, ...] = ("zoning", "road", "equity", "demand")) -> Column:
    """The first fault of weights that come as a JSON object; null for good ones.

    Exactly the keys; each a whole number or a decimal written as a text, since a
    number with a point is a float, whose sum can't be told to be exact; from 0
    to 1; not all zero; with eight places they add up to exactly 1.
    """
    parsed = F.try_parse_json(text)
    kinds = F.array(*[F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) for k in keys])
    values = F.array(*[F.try_variant_get(parsed, f"$.{k}", "string").try_cast("decimal(28,12)") for k in keys])
    names = F.array_sort(F.json_object_keys(text))
    total = F.aggregate(values, F.lit(0).cast("decimal(20,8)"), lambda t, w: (t + F.bround(w, 8)).cast("decimal(20,8)"))
    return (
        F.when(parsed.isNull() | names.isNull(), "NOT_AN_OBJECT")
        .when(names != F.array(*[F.lit(k) for k in sorted(keys)]), "KEYS")
        .when(F.exists(kinds, lambda k: ~k.isin("BIGINT", "STRING")), "NOT_EXACT")
        .when(F.exists(values, lambda w: w.isNull()), "NOT_A_NUMBER")
        .when(F.exists(values, lambda w: (w < 0) | (w > 1)), "OUT_OF_RANGE")
        .when(F.forall(values, lambda w: w == 0), "ALL_ZERO")
        .when(total != 1, "SUM")
    )


def composite(weights: Mapping[str, str]) -> Column:
    """Weighted sum, four places half-even; null if any component is."""
    return half_even(reduce(lambda a, b: a + b, [F.col(k) * F.lit(w).cast("decimal(9,8)") for k, w in weights.items()]), 4, 9)


def provisional(weights: Mapping[str, str]) -> Column:
    """Weighted mean over the components that are there; null without any or with weight 0."""
    num = reduce(lambda a, b: a + b, [F.coalesce(F.col(k) * F.lit(w).cast("decimal(9,8)"), F.lit(0).cast("decimal(20,12)")) for k, w in weights.items()])
    den = reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), F.lit(w).cast("decimal(9,8)")).otherwise(F.lit(0).cast("decimal(9,8)")) for k, w in weights.items()])
    return half_even(F.try_divide(num, F.nullif(den, F.lit(0).cast("decimal(9,8)"))), 4, 9)


def resolve_status(exclusions: Column, reviews: Column, components: list[str]) -> Column:
    """EXCLUDED with any exclusion, else REVIEW_REQUIRED with any review reason or missing component, else ELIGIBLE."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in components])
    return F.when(F.size(exclusions) > 0, "EXCLUDED").when((F.size(reviews) > 0) | missing, "REVIEW_REQUIRED").otherwise("ELIGIBLE")


def critic_weights(df: DataFrame, columns: list[str]) -> dict[str, Decimal]:
    """CRITIC weights of columns in 0..100, eight places, the rounding rest on the most informative.

    One aggregate gives sums and cross products; the finish is in 60 digits.
    """
    sums = [F.count(F.lit(1)).alias("n")]
    exact = {c: F.col(c).cast("decimal(9,4)") for c in columns}
    sums += [F.sum(exact[c]).alias(f"s{i}") for i, c in enumerate(columns)]
    sums += [F.sum(exact[a] * exact[b]).alias(f"p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    row = df.na.drop(subset=columns).agg(*sums).first()
    n = row["n"]
    if n < 2:
        raise ValueError("CRITIC needs two rows at least")
    with localcontext() as ctx:
        ctx.prec = 60
        k = len(columns)
        mean = [row[f"s{i}"] / n / 100 for i in range(k)]
        cov = {(i, j): row[f"p{i}_{j}"] / n / 10000 - mean[i] * mean[j] for i in range(k) for j in range(i, k)}
        sd = [max(cov[i, i], Decimal(0)).sqrt() for i in range(k)]
        live = [i for i in range(k) if sd[i] > Decimal("1e-25")]

        def r(i: int, j: int) -> Decimal:
            x = cov[min(i, j), max(i, j)] / (sd[i] * sd[j])
            return max(Decimal(-1), min(Decimal(1), x))

        info = [Decimal(0)] * k
        for i in live:
            others = [j for j in live if j != i]
            info[i] = sd[i] * sum(1 - r(i, j) for j in others) if others else sd[i]
        total = sum(info)
        if total <= 0:
            raise ValueError("no column carries information")
        unit = Decimal("1e-8")
        out = [(x / total).quantize(unit, ROUND_HALF_EVEN) for x in info]
        top = max(range(k), key=lambda i: info[i])
        out[top] += 1 - sum(out)
    return dict(zip(columns, out))
