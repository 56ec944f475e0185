"""Span masking of token-id arrays as a column expression; the simpler noises are in ``functions.arrays``.

All draws are seeded hashes of the row id and a position or number, so a row's result
depends on nothing else and can be repeated in SQL.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.hashing import state, state_sql, uniform, uniform_sql
from tandem.functions.text import bind


@dataclass(frozen=True)
class SpanNoise:
    share: float = 0.15                              # part of the row to mask
    length_weights: Sequence[float] = (1, 4, 3, 2)   # weight of span lengths 0, 1, 2, ...
    outcome_weights: Sequence[float] = (0.8, 0.1, 0.1)  # mask, keep, random token
    random_insert: float = 0.1                       # part of inserted tokens that are random
    mask_id: int = 5
    first_word: int = 10
    vocab_size: int = 50000

    def length_cuts(self) -> list[float]:
        """A draw's span length is the number of these that it reaches."""
        total = sum(self.length_weights)
        return [round(c / total, 9) for c in accumulate(self.length_weights)][:-1]

    def outcome_cuts(self) -> list[float]:
        return [round(c, 9) for c in accumulate(self.outcome_weights)][:-1]


def _random(cfg: SpanNoise, seed: int, low: int, *ids: Column) -> Column:
    return (F.lit(low) + F.floor(uniform(seed, *ids) * (cfg.vocab_size - low))).cast("bigint")


def _longs() -> Column:
    return F.array().cast("array<bigint>")


def _count(n: Column) -> Column:
    """0 .. n - 1; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(_longs())


def _lengths(budget: Column, cfg: SpanNoise, seed: int, row_id: Column) -> Column:
    """Span lengths, drawn until they add up to the budget; the last is cut to fit."""
    def draw(k: Column) -> Column:
        u = uniform(seed + 1, row_id, k)
        return sum(((u >= c).cast("bigint") for c in cfg.length_cuts()), F.lit(0).cast("bigint"))

    def step(acc: Column, size: Column) -> Column:
        return F.when(acc["sum"] >= budget, acc).otherwise(F.struct(
            (acc["sum"] + size).alias("sum"), (acc["used"] + 1).alias("used"), size.alias("last")))

    def fitted(draws: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        end = F.aggregate(draws, F.struct(zero.alias("sum"), F.lit(0).alias("used"), zero.alias("last")), step)
        return bind(end, lambda e: F.concat(F.slice(draws, F.lit(1), e["used"] - 1),
                                            F.array(F.least(e["last"], budget - e["sum"] + e["last"]))))

    return bind(F.transform(_count(budget), draw), fitted)


def span_masked(ids: Column, row_id: Column, cfg: SpanNoise = SpanNoise(), seed: int = 0) -> Column:
    """``ids`` with spans masked up to the budget; both end marks stay.

    Spans start at the inner places of least hash. A span shrinks to its first token,
    which is masked, kept or replaced; a span of length 0 inserts a token somewhere inside.
    Rows without inner tokens pass through. Everything a token's own expression mentions is bound once a row,
    so time grows with the ids (and the sort of their places), however long a row is.
    """
    n = F.size(ids).cast("bigint")
    budget = F.ceil(n * F.lit(cfg.share))
    wide = 1 << 31  # a hash is below it, and so is a place

    def place(p: Column) -> Column:
        return state(seed + 2, row_id, p) * wide + p

    def token(p: Column, last: Column) -> Column:
        masked, kept = cfg.outcome_cuts()
        own = F.get(ids, p.cast("int"))
        changed = bind(uniform(seed + 3, row_id, p), lambda u: F.when(u < masked, F.lit(cfg.mask_id).cast("bigint"))
                       .when(u < kept, own).otherwise(_random(cfg, seed + 4, 0, row_id, p)))
        return F.when(place(p) <= last, changed).otherwise(own)

    def shrunk(spans: Column) -> Column:
        inner = F.sequence(F.lit(1).cast("bigint"), n - 2)
        used = F.least(F.size(spans).cast("bigint"), n - 2).cast("int")
        starts = F.slice(F.sort_array(F.transform(inner, place)), F.lit(1), used)

        def behind(s: Column, size: Column) -> Column:
            p = F.pmod(s, F.lit(wide))
            return F.when((size > 1) & (p + 1 <= n - 2), F.sequence(p + 1, F.least(p + size - 1, n - 2))).otherwise(_longs())

        def rest(found: Column) -> Column:
            gone = F.flatten(F.zip_with(found, F.slice(spans, F.lit(1), F.size(found)), behind))
            # the place itself is compared with the last start: no look-up per token
            last = F.coalesce(F.array_max(found), F.lit(-1).cast("bigint"))
            return bind(last, lambda x: F.transform(F.array_except(inner, gone), lambda p: token(p, x)))

        return F.concat(F.slice(ids, 1, 1), bind(starts, rest), F.slice(ids, -1, 1))

    def inserted(row: Column, count: Column) -> Column:
        def fresh(k: Column) -> Column:
            value = F.when(uniform(seed + 6, row_id, k) < cfg.random_insert, _random(
                cfg, seed + 7, cfg.first_word, row_id, k)).otherwise(F.lit(cfg.mask_id).cast("bigint"))
            gap = F.floor(uniform(seed + 5, row_id, k) * (F.size(row) - 1)).cast("int")
            return F.struct(gap.alias("at"), k.alias("k"), value.alias("v"))

        def joined(new: Column) -> Column:
            # the tokens up to each gap, then the new one, then those behind the last gap
            def part(x: Column, i: Column) -> Column:
                after = F.coalesce(F.get(new, i - 1)["at"], F.lit(-1))
                return F.concat(F.slice(row, after + 2, x["at"] - after), F.array(x["v"]))

            end = F.element_at(new, -1)["at"]
            return F.concat(F.flatten(F.transform(new, part)), F.slice(row, end + 2, F.size(row)))

        return bind(F.sort_array(F.transform(_count(count), fresh)), joined)

    def masked(lengths: Column) -> Column:
        zero = F.size(F.filter(lengths, lambda x: x == 0)).cast("bigint")
        whole = bind(F.filter(lengths, lambda x: x > 0), shrunk)
        return bind(F.struct(whole.alias("row"), zero.alias("zero")),
                    lambda b: F.when(b["zero"] > 0, bind(b["row"], lambda row: inserted(row, b["zero"]))).otherwise(b["row"]))

    return F.when(F.coalesce(n <= 2, F.lit(True)), ids).otherwise(bind(_lengths(budget, cfg, seed, row_id), masked))


def mask_spans(df: DataFrame, row_id: str, ids: str, cfg: SpanNoise = SpanNoise(), seed: int = 0) -> DataFrame:
    """``row_id, ids`` with the ids ``span_masked``."""
    return df.select(row_id, span_masked(F.col(ids), F.col(row_id), cfg, seed).alias(ids))


def span_sql(source: str, row_id: str, cfg: SpanNoise = SpanNoise(), seed: int = 0) -> str:
    """CTEs ending in ``masked`` (row id, n, ids joined by blanks) over ``source`` (row id, ids)."""
    u = [uniform_sql(seed + i, row_id, x) for i, x in ((1, "k"), (3, "p"), (4, "p"), (5, "k"), (6, "k"), (7, "k"))]
    length = " + ".join(f"({u[0]} >= {c})::INT" for c in cfg.length_cuts())
    masked, kept = cfg.outcome_cuts()
    return f"""base AS (SELECT {row_id}, ids, len(ids) AS n, ceil(len(ids) * {cfg.share})::BIGINT AS budget FROM {source}),
draws AS (SELECT {row_id}, budget, k, {length} AS size FROM base, unnest(range(budget)) d(k) WHERE n > 2),
sums AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY {row_id} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM draws),
spans AS (SELECT {row_id}, k, least(size, budget - before)::BIGINT AS size FROM sums WHERE before < budget),
numbered AS (SELECT {row_id}, size, row_number() OVER (PARTITION BY {row_id}, size > 0 ORDER BY k) AS j FROM spans),
places AS (SELECT {row_id}, n, p, ids[p + 1] AS own, row_number() OVER (PARTITION BY {row_id} ORDER BY {state_sql(seed + 2, row_id, "p")}, p) AS j
  FROM base, unnest(range(1, n - 1)) q(p)),
starts AS (SELECT {row_id}, p, n, size FROM places JOIN numbered USING ({row_id}, j) WHERE size > 0),
gone AS (SELECT DISTINCT {row_id}, g AS p FROM starts, unnest(range(p + 1, least(p + size - 1, n - 2) + 1)) r(g)),
inner_ AS (SELECT {row_id}, p, CASE WHEN s.size IS NULL THEN own WHEN {u[1]} < {masked} THEN {cfg.mask_id} WHEN {u[1]} < {kept} THEN own
  ELSE floor({u[2]} * {cfg.vocab_size})::BIGINT END AS v FROM places LEFT JOIN starts s USING ({row_id}, p) ANTI JOIN gone USING ({row_id}, p)),
kept AS (SELECT {row_id}, v, row_number() OVER (PARTITION BY {row_id} ORDER BY p) - 1 AS slot, count(*) OVER (PARTITION BY {row_id}) AS m FROM (
  SELECT * FROM inner_ UNION ALL SELECT {row_id}, 0, ids[1] FROM base UNION ALL SELECT {row_id}, n - 1, ids[n] FROM base)),
fresh AS (SELECT {row_id}, j - 1 AS k FROM numbered WHERE size = 0),
final AS (SELECT {row_id}, slot, 0 AS k, v FROM kept UNION ALL
  SELECT {row_id}, floor({u[3]} * (m - 1))::BIGINT, k + 1, CASE WHEN {u[4]} < {cfg.random_insert}
    THEN {cfg.first_word} + floor({u[5]} * {cfg.vocab_size - cfg.first_word})::BIGINT ELSE {cfg.mask_id} END
  FROM fresh JOIN (SELECT DISTINCT {row_id}, m FROM kept) USING ({row_id})),
masked AS (SELECT {row_id}, count(*)::INT AS n, string_agg(v, ' ' ORDER BY slot, k) AS ids FROM final GROUP BY {row_id})"""
