"""Problem 2: prices in many currencies, time spans, counting units and scales, in common units.

Each row's own texts and fields are evidence for how it is meant; a site's note fills what the row
leaves open, and fixes a scale for the whole site. What the evidence leaves open (a separator that can be a decimal
point or group digits, a scale nobody tells) is the hidden state of a Markov model, decoded by Viterbi for
the prices of each page in their order:

* the emission is the cost of a reading by the row's own texts and its field ``value``,
* the logarithm of the common amount must stay near a smooth level, which each path carries along for each
  common unit; it starts from the medians of the site and of all rows (one grouped aggregation) and
  follows the amounts slowly. Inside the usual spread of a unit a price costs nothing, beyond it the square,
* the scale is a state that lasts: entering a scale that nobody tells costs once, staying in it nothing.

So a lone price a thousand times off its level is corrected, and so are blocks of rows that are a thousand
or a hundred times off, at any place of a page. What a row tells itself is never overridden. The model
cannot correct a page whose site has most rows off in the same way: then that is the site's level.

Rows are read before anything is shuffled; ids and readings are shuffled, not texts. A series of more than ``HOT`` rows (copies of one page, rows
that name no page) is spread over several parts by a hash of the id; each part starts from the same
level. Inside a task at most ``BLOCK`` rows are held; the scores of a series go on to its next block.

Rows without an amount, without a currency or time span told anywhere, and one-off prices have no common
amount and do not come out. All columns may be null; repeated ids come out as often as they came in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .pricewords import currency_of, read_note, read_row, span_of, unit_of

#: Rows of a series above which it is spread, and rows that a task decodes at once.
HOT, BLOCK = 50_000, 2_048
#: Cost (nats) of a reading against the field ``value`` and of the unlikelier reading of a separator.
AGAINST_VALUE, UNLIKELIER = 3.0, 1.0
#: Scales that may be meant though nobody tells them.
OPEN_SCALES = (1e3, 1e4, 1e6, 1e-2, 1e-3)
#: Cost of entering such a scale, and of going back.
ENTER, LEAVE = 7.0, 2.0
#: Cost of each squared decade beyond the usual spread; share by which a level follows an amount; least spread (decades).
PULL, FOLLOW, LEAST_SPREAD = 2.5, 0.1, 0.5
#: Rows of a site that weigh as much as the whole table in its starting level.
SITE_WEIGHT = 20.0

_READ = "hit_id bigint, site string, series bigint, line int, unit string, amounts array<double>, costs array<double>, told double, stated_e4 bigint"


def readings(row: dict, rates: dict[str, float], factors: dict[str, tuple[str, float]]) -> dict | None:
    """How a row can be read: common unit, amounts in it before any scale (likeliest first) with their costs, and the scale that is told; None if it has no price.

    ``rates`` are dollars for one unit of money, ``factors`` (base unit, how many) of spans and counting units.
    """
    told = read_row(row["raw"], row["context"])
    if told is None:
        return None
    note = read_note(row["note"])
    country = row["country"]
    spans = [x for x in (told["span"], span_of(row["period"]), note["span"] if note else None) if x]
    if not spans or spans[0][0] == "once":
        return None
    money = open_money = None
    for text in (row["raw"], row["currency"], row["context"]):
        code, share, sure = currency_of(text, country)
        if code and sure:
            money = (code, share)
            break
        if code and open_money is None:
            open_money = (code, share)
    if money is None:
        money = open_money or ((note["currency"], 1.0) if note else None)
    if money is None or money[0] not in rates:
        return None
    unit = told["unit"] or unit_of(row["per"]) or (note["unit"] if note else None) or ("", 1.0)
    span = spans[0]
    if span[0] not in factors or (unit[0] and unit[0] not in factors):
        return None
    base, per_unit = factors[unit[0]] if unit[0] else ("", 1.0)
    divisor = factors[span[0]][1] * span[1] * unit[1] * per_unit
    if not divisor:
        return None
    scale = told["scale"] if told["scale"] is not None else note["scale"] if note else None
    if scale is None and told["magnitude"] != 1:
        scale = 1.0  # a magnitude at the number is the scale
    value, costs = row["value"], []
    for i, amount in enumerate(told["amounts"]):
        against = value is not None and len(told["amounts"]) > 1 and not any(math.isclose(value, x, rel_tol=1e-9) for x in (amount, told["plain"][i]))
        costs.append(UNLIKELIER * i + AGAINST_VALUE * against)
    name = f"USD/{base}/month" if base else "USD/month"
    stated = (row["currency"], row["period"], row["per"]) == ("USD", "month", base or None) and value is not None
    return {"unit": name, "amounts": [a * money[1] * rates[money[0]] / divisor for a in told["amounts"]], "costs": costs, "told": scale, "stated": math.floor(value * 1e4 + 0.5) if stated else None}


class Decoder:
    """Viterbi over the readings of one series, in blocks of rows (unit, amounts, costs, told scale, starting level, spread)."""

    def __init__(self) -> None:
        #: scale -> (score, level by unit) of the best path that ends in it; only the state without an open scale at first
        self.paths: dict[float, tuple[float, dict[str, float]]] = {1.0: (0.0, {})}

    @staticmethod
    def _off(amount: float, level: float, spread: float) -> tuple[float, float]:
        """(cost of the distance from the level, the level after the amount)."""
        if amount <= 0:
            return 0.0, level
        x = math.log10(amount)
        far = abs(x - level)
        step = max(-spread, min(spread, x - level))
        return (PULL * (far - spread) ** 2 if far > spread else 0.0), level + FOLLOW * step

    def _best(self, row: tuple, scale: float, levels: dict[str, float]) -> tuple[float, int, float]:
        """(cost, reading, level after it) of the best reading of a row in a scale."""
        unit, amounts, costs, told, start, spread = row
        factor, level = scale if told is None else told, levels.get(unit, start)
        best = None
        for i, (a, c) in enumerate(zip(amounts, costs)):
            off, after = self._off(a * factor, level, spread)
            if best is None or c + off < best[0]:
                best = (c + off, i, after)
        return best

    def decode(self, rows: list[tuple]) -> list[tuple[int, float]]:
        """(reading, scale) of each row; scores go on to the next block."""
        plain = self._plain(rows)
        if plain is not None:
            return plain
        back: list[dict[float, tuple[float, int]]] = []
        for row in rows:
            after, links = {}, {}
            for scale in (1.0, *OPEN_SCALES):
                best = None
                for before, (score, levels) in self.paths.items():
                    moved = score + (0.0 if before == scale else LEAVE if scale == 1.0 else ENTER)
                    if best is not None and moved >= best[0]:
                        continue
                    cost, i, level = self._best(row, scale, levels)
                    if best is None or moved + cost < best[0]:
                        best = (moved + cost, before, i, level, levels)
                after[scale] = (best[0], {**best[4], row[0]: best[3]})
                links[scale] = (best[1], best[2])
            self.paths = after
            back.append(links)
        scale = min(self.paths, key=lambda s: (self.paths[s][0], abs(math.log10(s))))
        self.paths = {scale: (0.0, self.paths[scale][1])}
        out = []
        for links, row in zip(reversed(back), reversed(rows)):
            before, i = links[scale]
            out.append((i, scale if row[3] is None else row[3]))
            scale = before
        return out[::-1]

    def _plain(self, rows: list[tuple]) -> list[tuple[int, float]] | None:
        """The path without an open scale, if it costs less than entering one: then no other path is better."""
        if set(self.paths) != {1.0}:
            return None
        levels, lost, out = dict(self.paths[1.0][1]), 0.0, []
        for row in rows:
            cost, i, level = self._best(row, 1.0, levels)
            lost += cost - min(row[2])
            if lost >= ENTER:
                return None
            levels[row[0]] = level
            out.append((i, 1.0 if row[3] is None else row[3]))
        self.paths = {1.0: (0.0, levels)}
        return out


def _levels(read: DataFrame) -> DataFrame:
    """(site, unit, level, spread): where the logarithms of amounts start and how far they usually go, from the likeliest readings of all rows."""
    likeliest = F.col("amounts")[F.array_position("costs", F.array_min("costs")).cast("int") - 1]
    x = read.where(likeliest > 0).select("site", "unit", F.log10(likeliest * F.coalesce("told", F.lit(1.0))).alias("x"))
    of_site = x.groupBy("site", "unit").agg(F.percentile_approx("x", 0.5, 1000).alias("level"), F.count(F.lit(1)).alias("n"))
    every = x.groupBy("unit").agg(F.percentile_approx("x", [0.05, 0.5, 0.95], 1000).alias("q"))
    level = (F.col("level") * F.col("n") + F.col("q")[1] * SITE_WEIGHT) / (F.col("n") + SITE_WEIGHT)
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 2, F.lit(LEAST_SPREAD))
    # the right side has one row for each common unit, named in ``unit_factors``
    return of_site.join(F.broadcast(every), "unit").select("site", "unit", level.alias("level"), spread.alias("spread"))


def _read(hits: DataFrame, sites: DataFrame, fx: DataFrame, units: DataFrame) -> DataFrame:
    """The readings of all rows that have a price, in one pass over the texts."""
    spark = hits.sparkSession
    rates = {r.currency: r.usd_per_unit for r in fx.where("currency is not null and usd_per_unit is not null").select("currency", "usd_per_unit").collect()}
    factors = {r.unit: (r.base_unit, r.factor) for r in units.where("unit is not null and factor is not null").select("unit", "base_unit", "factor").collect()}
    tables = spark.sparkContext.broadcast((rates, factors))
    about = sites.where("site is not null").groupBy("site").agg(F.max("country").alias("country"), F.max("price_note").alias("note"))
    page = F.xxhash64(F.coalesce("site", F.lit("")), F.coalesce("doc", "url", F.lit("")))
    rows = hits.select("hit_id", "site", page.alias("series"), F.coalesce("line", F.lit(0)).alias("line"), "value", "currency", "period", "per", "raw", "context").join(about, "site", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates, factors = tables.value
        for b in batches:
            out = []
            for r in b.to_pylist():
                got = readings(r, rates, factors)
                if got:
                    out.append((r["hit_id"], r["site"] or "", r["series"], r["line"], got["unit"], got["amounts"], got["costs"], got["told"], got["stated"]))
            kinds = [("hit_id", pa.int64()), ("site", pa.string()), ("series", pa.int64()), ("line", pa.int32()), ("unit", pa.string()), ("amounts", pa.list_(pa.float64())), ("costs", pa.list_(pa.float64())), ("told", pa.float64()), ("stated_e4", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return cut(spread(rows).mapInArrow(run, _READ))


def harmonize(hits: DataFrame, sites: DataFrame, fx: DataFrame, units: DataFrame) -> DataFrame:
    """(hit_id, common_unit, common_amount, amount_e4, scale, changed, stated) of every row that can be converted.

    ``changed`` tells whether the path took another reading than the likeliest of the row by itself, ``stated`` whether the
    fields already state exactly that. ``fx`` (currency, usd_per_unit) and ``units`` (kind, unit, base_unit, factor) are tables
    of named units, bounded by their nature; they go to the driver and from there to the tasks. ``sites`` (site,
    country, price_note) is joined.
    """
    read = _read(hits, sites, fx, units)
    large = read.groupBy("series").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)  # at most rows / HOT series
    parts = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("hit_id"), F.ceil(F.col("n") / HOT))).otherwise(F.lit(0))
    rows = read.join(large, "series", "left").withColumn("part", parts.cast("int")).drop("n").join(_levels(read), ["site", "unit"], "left")
    ordered = rows.repartition("series", "part").sortWithinPartitions("series", "part", "line", "hit_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        decoder = None
        last = None

        def close() -> list[tuple]:
            out = []
            for r, (i, scale) in zip(held, decoder.decode([(r["unit"], r["amounts"], r["costs"], r["told"], r["level"] or 0.0, r["spread"] or LEAST_SPREAD) for r in held])):
                amount = r["amounts"][i] * scale
                e4 = math.floor(amount * 1e4 + 0.5)
                first = min(range(len(r["costs"])), key=r["costs"].__getitem__)
                out.append((r["hit_id"], r["unit"], amount, e4, scale, i != first or (r["told"] is None and scale != 1.0), r["stated_e4"] == e4))
            held.clear()
            return out

        for b in batches:
            done: list[tuple] = []
            for r in b.to_pylist():
                key = (r["series"], r["part"])
                if held and (key != last or len(held) == BLOCK):
                    done += close()
                if key != last:
                    decoder, last = Decoder(), key
                held.append(r)
            yield _batch(done)
        if held:
            yield _batch(close())

    schema = "hit_id bigint, common_unit string, common_amount double, amount_e4 bigint, scale double, changed boolean, stated boolean"
    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("hit_id", pa.int64()), ("common_unit", pa.string()), ("common_amount", pa.float64()), ("amount_e4", pa.int64()), ("scale", pa.float64()), ("changed", pa.bool_()), ("stated", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
