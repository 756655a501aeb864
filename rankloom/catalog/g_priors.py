"""Smoothed target priors. The out-of-fold SQL refits every fold; Spark subtracts."""

from __future__ import annotations

from rankloom.catalog.base import query
from rankloom.operators import priors

ID = "srch_id prop_id "
_SUM = {"n": "1", "book": "booking_bool", "click": "click_bool", "click_only": "click_only"}


def prior_sql(blocks, oof: bool) -> str:
    folds = "f AS (SELECT unnest(range(5)) AS f)" if oof else "f AS (SELECT 0 AS f)"
    on, mine = ("fold <> f", "fold") if oof else ("true", "0")
    ctes, joins, outs = [folds], [], []
    for i, block in enumerate(blocks):
        where = "WHERE random_bool = 1" if block.random_only else ""
        names = sorted({"n"} | {r.numerator for r in block.rates} | {r.denominator for r in block.rates})
        sums = ", ".join(f"CAST(sum({_SUM[m]}) AS DOUBLE) AS {m}" for m in names)
        keys = ", ".join(f"{k} AS k{j}" for j, k in enumerate(block.keys))
        group = ", ".join(str(j + 2) for j in range(len(block.keys)))
        ctes.append(f"t{i} AS (SELECT f, {keys}, {sums} FROM f JOIN scored ON {on} {where} GROUP BY 1, {group})")
        ctes.append(f"g{i} AS (SELECT f, {sums} FROM f JOIN scored ON {on} {where} GROUP BY 1)")
        match = " AND ".join(f"t{i}.k{j} = s.{k}" for j, k in enumerate(block.keys))
        joins.append(f"JOIN g{i} ON g{i}.f = s.{mine} LEFT JOIN t{i} ON t{i}.f = s.{mine} AND {match}"
                     if oof else f"JOIN g{i} ON true LEFT JOIN t{i} ON {match}")
        for r in block.rates:
            base = f"g{i}.n" if r.denominator == "n" else f"greatest(g{i}.{r.denominator}, 1)"
            outs.append(
                f"(coalesce(t{i}.{r.numerator}, 0) + {block.m} * g{i}.{r.numerator} / {base})"
                f" / (coalesce(t{i}.{r.denominator}, 0) + {block.m}) AS {r.out}"
            )
        if block.count:
            outs.append(f"CAST(coalesce(t{i}.n, 0) AS BIGINT) AS {block.count}")
    return f"\n, {', '.join(ctes)}\nSELECT s.srch_id, s.prop_id, {', '.join(outs)} FROM scored s {' '.join(joins)}"


def _register(name: str, blocks, oof: bool) -> None:
    counts = " ".join(b.count for b in blocks if b.count)
    rates = " ".join(r.out for b in blocks for r in b.rates)

    @query(name, prior_sql(blocks, oof), exact=ID + counts, d6=rates)
    def run(ctx):
        if oof:
            return priors.smoothed_priors(ctx.folds, ctx.folds, blocks, 5)
        return priors.smoothed_priors(ctx.log, ctx.log, blocks)


_register("G1_hotel_rates", (priors.HOTEL_RATES,), False)
_register("G2_destination_rate", (priors.DESTINATION_RATE,), False)
_register("G3_destination_hotel_affinity", (priors.DESTINATION_HOTEL,), False)
_register("G4_country_pair_rates", (priors.COUNTRY_PAIR,), False)
_register("G1_G4_random_order_rates_oof", priors.RANDOM_ORDER_SET, True)
_register("G5_hotel_context_rates", priors.HOTEL_CONTEXT_SET, False)
_register("G6_destination_star_priors", (priors.DESTINATION_STAR,), False)
_register("G7_hotel_window_priors", (priors.HOTEL_WINDOW,), False)
_register("G8_hotel_priors", (priors.HOTEL_ALL_ROWS,), False)
_register("G9_target_priors_oof", priors.TARGET_SET, True)
_register("G10_hotel_priors_oof", (priors.HOTEL_ALL_ROWS,), True)
_register("G11_click_to_book", (priors.CLICK_TO_BOOK,), False)
_register("G12_destination_window_prior", (priors.DESTINATION_WINDOW,), False)
_register("G13_country_pair_star_priors", (priors.COUNTRY_PAIR_STAR,), False)
_register("G14_velocity_priors_oof", priors.VELOCITY_SET, True)


def lattice_sql(lattices, oof: bool) -> str:
    folds = "f AS (SELECT unnest(range(5)) AS f)" if oof else "f AS (SELECT 0 AS f)"
    on = "fold <> f" if oof else "true"
    mine = "s.fold" if oof else "0"
    ctes = [
        folds,
        f"g AS (SELECT f, avg(CAST(booking_bool AS DOUBLE)) AS gb FROM f JOIN scored ON {on} GROUP BY 1)",
        f"p AS (SELECT f, prop_id AS pk, sum(booking_bool) AS b, count(*) AS n FROM f JOIN scored ON {on} GROUP BY 1, 2)",
        "pr AS (SELECT p.f, pk, (b + 80 * gb) / (n + 80) AS parent FROM p JOIN g USING (f))",
    ]
    joins, outs = [f"JOIN g ON g.f = {mine}"], []
    for i, (prefix, ctx_col) in enumerate(lattices.items()):
        ctes.append(
            f"c{i} AS (SELECT x.f, x.pk, x.ck, (x.b + 40 * parent) / (x.n + 40) AS rate, parent, x.n FROM "
            f"(SELECT f, prop_id AS pk, {ctx_col} AS ck, sum(booking_bool) AS b, CAST(count(*) AS DOUBLE) AS n "
            f"FROM f JOIN scored ON {on} GROUP BY 1, 2, 3) x JOIN pr ON pr.f = x.f AND pr.pk = x.pk)"
        )
        joins.append(f"LEFT JOIN c{i} ON c{i}.f = {mine} AND c{i}.pk = s.prop_id AND c{i}.ck = s.{ctx_col}")
        outs += [
            f"coalesce(c{i}.rate, gb) AS {prefix}_book", f"coalesce(c{i}.rate - c{i}.parent, 0) AS {prefix}_lift",
            f"coalesce(c{i}.n / (c{i}.n + 40), 0) AS {prefix}_reliability",
        ]
    return f"\n, {', '.join(ctes)}\nSELECT s.srch_id, s.prop_id, {', '.join(outs)} FROM scored s {' '.join(joins)}"


_ONE = {"lattice_prop_dest": "srch_destination_id"}
_names = lambda lattices: " ".join(f"{p}_{k}" for p in lattices for k in ("book", "lift", "reliability"))


@query("G15_hierarchical_prior", lattice_sql(_ONE, False), exact=ID, d6=_names(_ONE))
def hierarchical(ctx):
    return priors.hierarchical_priors(ctx.log, ctx.log, lattices=_ONE)


@query("G16_lattice_oof", lattice_sql(priors.LATTICES, True), exact=ID, d6=_names(priors.LATTICES))
def lattice(ctx):
    return priors.hierarchical_priors(ctx.folds, ctx.folds, 5)
