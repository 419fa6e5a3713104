"""Rule language, parameter sweeps, bar-return backtests and walk-forward folds.

Rules and parameter sets are literals folded into the plan: every bar is exploded over them in
place, so a sweep needs no join and multiplies the parallelism by the number of rules.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.functions.mathx import clip
from marketlab.operators.folds import ema_series
from marketlab.operators.indicators import Series, atr_series, vol_norm

RULE_FEATURES = ("rsi", "pos20", "mom_1h", "mom_4h", "macd_norm", "vol_ratio", "ema_cross")
OPS = (">", "<")
MAX_CLAUSES = 3
CLAUSE = "array<struct<feat:string,op:string,thr:double>>"
RULE_SCHEMA = f"array<struct<rule_id:string,long:{CLAUSE},short:{CLAUSE},conf:double>>"


def with_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Each row once per rule."""
    return df.withColumn("rule", F.explode(F.from_json(F.lit(json.dumps(rules)), RULE_SCHEMA)))


def rule_vote(df: DataFrame, features=RULE_FEATURES) -> DataFrame:
    """+conf if all long clauses hold, else -conf if all short clauses hold, else 0."""
    m = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
    x = df.withColumn("_m", m)

    def holds(side):
        def one(c):
            v = F.try_element_at(F.col("_m"), c["feat"])
            return F.coalesce(F.when(c["op"] == ">", v > c["thr"]).otherwise(v < c["thr"]), F.lit(False))
        return (F.coalesce(F.size(side), F.lit(0)) > 0) & F.coalesce(F.forall(side, one), F.lit(False))

    conf = clip(F.coalesce(F.col("rule.conf"), F.lit(0.5)))
    return x.withColumn("vote", F.when(holds(F.col("rule.long")), conf)
                        .when(holds(F.col("rule.short")), -conf).otherwise(0.0)).drop("_m")


def validate_rules(rules: DataFrame, features=RULE_FEATURES) -> DataFrame:
    """Keep well-formed rules: known features and operators, numeric thresholds, 1-3 clauses
    on at least one side, 0 < conf <= 1. Columns rule_id, long, short, conf."""
    def bad(c):
        return (~F.coalesce(c["feat"].isin(*features), F.lit(False)) | ~F.coalesce(c["op"].isin(*OPS), F.lit(False))
                | c["thr"].isNull() | F.isnan(c["thr"]))

    def n(side):
        return F.coalesce(F.size(side), F.lit(0))

    ok = (F.coalesce(F.col("conf"), F.lit(0.5)) > 0) & (F.coalesce(F.col("conf"), F.lit(0.5)) <= 1)
    for side in ("long", "short"):
        ok = ok & (F.greatest(n(side), F.lit(0)) <= MAX_CLAUSES) & ~F.coalesce(F.exists(side, bad), F.lit(False))
    return rules.where(ok & ((n("long") > 0) | (n("short") > 0)))


def rule_key(side) -> Column:
    """Order-insensitive text of one side's clauses, thresholds to four digits."""
    return F.array_join(F.array_sort(F.transform(F.coalesce(side, F.array().cast(CLAUSE)), lambda c: F.concat_ws(
        "|", c["feat"], c["op"], F.format_string("%.4f", c["thr"])))), ";")


def rule_id(df: DataFrame) -> DataFrame:
    """Canonical id of a rule, equal for reordered clauses and rounded thresholds."""
    raw = F.concat_ws("#", rule_key(F.col("long")), rule_key(F.col("short")),
                      F.format_string("%.3f", F.coalesce(F.col("conf"), F.lit(0.5))))
    return df.withColumn("canonical_id", F.concat(F.lit("disc_"), F.substring(F.sha1(raw), 1, 10)))


def dedupe_rules(df: DataFrame) -> DataFrame:
    """U4: one rule per canonical id, the smallest rule_id."""
    x = rule_id(df)
    return (x.groupBy("canonical_id").agg(F.min_by(F.struct(*df.columns), "rule_id").alias("_r"))
            .select("canonical_id", "_r.*"))


def rule_backtest(df: DataFrame, fee_bps: float = 6.0, keys=("rule_id", "product"), ts="ts") -> DataFrame:
    """Position from the vote's sign, return of the next bar less fees on turnover.

    Needs `vote` (0 while features are warming up) and `close`; the last bar has no return.
    """
    w = W.partitionBy(*keys).orderBy(ts)
    x = df.withColumn("pos", F.signum("vote"))
    x = x.withColumns({"_prev": F.coalesce(F.lag("pos").over(w), F.lit(0.0)), "_next": F.lead("close").over(w)})
    turn = F.abs(F.col("pos") - F.col("_prev"))
    r = F.when(F.col("close") > 0, F.col("_next") / F.col("close") - 1).otherwise(0.0)
    return (x.where(F.col("_next").isNotNull())
            .withColumns({"ret": F.col("pos") * r - turn * (fee_bps * 1e-4),
                          "entry": ((turn > 0) & (F.col("pos") != 0)).cast("int")})
            .drop("_prev", "_next"))


def fold_roles(df: DataFrame, n_folds: int = 4, embargo: int = 0, keys=("product",), ts="ts",
               train: bool = True) -> DataFrame:
    """Expanding walk-forward folds with an embargo; a row appears once per fold it serves.

    Adds `fold` (1-based) and `role` (train / test); the last fold's test runs to the end.
    """
    w = W.partitionBy(*keys).orderBy(ts)
    x = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    x = x.withColumn("_step", F.floor(F.col("_n") / (n_folds + 1)))
    k = F.explode(F.sequence(F.lit(1), F.lit(n_folds)))
    x = x.withColumn("fold", k).where(F.col("_step") >= 1)
    end = F.col("_step") * F.col("fold")
    stop = F.when(F.col("fold") < n_folds, F.col("_step") * (F.col("fold") + 1)).otherwise(F.col("_n"))
    live = (end + embargo) < F.least(stop, F.col("_n"))
    role = F.when(F.col("_i") < end, "train").when((F.col("_i") >= end + embargo) & (F.col("_i") < stop), "test")
    x = x.where(live).withColumn("role", role).where(F.col("role").isNotNull())
    return (x if train else x.where("role = 'test'")).drop("_i", "_n", "_step")


def param_entries(bars: DataFrame, params: list[dict], key: str = "product") -> DataFrame:
    """Long / short entry of every parameter set at every bar (from the 60th on).

    A set holds ema_fast, ema_slow, breakout_n, rsi_buy, rsi_sell, mom_w, short_w, htf_w, htf_n,
    volz_w, vol_max, er_min, er_n. Each distinct span is computed once for all sets.
    """
    s = Series(key)
    spans = {p[k] for p in params for k in ("ema_fast", "ema_slow")} | {p["htf_n"] for p in params if p["htf_w"] > 0.5}
    x = ema_series(atr_series(bars, keys=key), "close", {f"e{n}": n for n in sorted(spans)}, key)
    x = vol_norm(x, keys=key)
    x = x.withColumns({"_rn": s.rownum(), "_c12": s.lag("close", 12), "_st": F.abs(F.col("close") - s.lag("close"))})
    more = {}
    for n in sorted({p["breakout_n"] for p in params}):
        more[f"up{n}"] = F.max("high").over(s.tail(n, -1))
        more[f"dn{n}"] = F.min("low").over(s.tail(n, -1))
    for n in sorted({p["er_n"] for p in params if p["er_min"] > 0}):
        path = F.sum("_st").over(s.tail(n))
        more[f"er{n}"] = F.when(path > 0, F.abs(F.col("close") - s.lag("close", n)) / path).otherwise(0.0)
    x = x.withColumns(more)
    c, t = F.col("close"), F.lit(True)
    sets = []
    for i, p in enumerate(params):
        up = F.col(f"e{p['ema_fast']}") > F.col(f"e{p['ema_slow']}")
        mom = p["mom_w"] > 0.5
        htf = F.col(f"e{p['htf_n']}") if p["htf_w"] > 0.5 else None
        gate = ((F.col("vol_norm") <= p["vol_max"]) if p["volz_w"] > 0.5 else t) & \
               ((F.col(f"er{p['er_n']}") >= p["er_min"]) if p["er_min"] > 0 else t) & (F.col("atr") > 0)
        long = (up & ((c >= F.col(f"up{p['breakout_n']}")) | (F.col("rsi") < p["rsi_buy"]))
                & (c > F.col("_c12") if mom else t) & (c > htf if htf is not None else t) & gate)
        short = (F.lit(p["short_w"] > 0.5) & ~up & ((c <= F.col(f"dn{p['breakout_n']}")) | (F.col("rsi") > p["rsi_sell"]))
                 & (c < F.col("_c12") if mom else t) & (c < htf if htf is not None else t) & gate)
        sets.append(F.struct(F.lit(i).alias("set_id"), long.alias("enter_long"), short.alias("enter_short")))
    x = x.where(F.col("_rn") >= 60).withColumn("_p", F.explode(F.array(*sets)))
    return x.select(*bars.columns, "atr", "_p.*")
