"""Keyed state: folds in order, saliency, coactivation, recall, promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.joins import RANGE_ROWS, in_ranges
from orrery.sources.shared import cut



def _then(f: Column, g: Column) -> Column:
    """The step that applies ``f`` and then ``g``; a step is x -> least(greatest(a x + b, lo), hi) with a >= 0."""
    clamp = lambda v: F.least(F.greatest(g["a"] * v + g["b"], g["lo"]), g["hi"])
    return F.struct((f["a"] * g["a"]).alias("a"), (f["b"] * g["a"] + g["b"]).alias("b"), clamp(f["lo"]).alias("lo"), clamp(f["hi"]).alias("hi"))


def _compose(steps: Column) -> Column:
    inf = float("inf")
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"))
    return F.aggregate(steps, none, lambda acc, s: _then(acc, s))


def ordered_fold(df: DataFrame, key: str, order: str, a: Column, b: Column, lo: float, hi: float, start: float, rows: int = RANGE_ROWS) -> DataFrame:
    """(key, state, n): x -> least(greatest(a x + b, lo), hi) over a key's rows in the order of a unique number, from ``start``.

    Such steps compose to a step of the same form, so a key's rows are folded in ranges of about ``rows`` rows first and
    the ranges after, whatever the numbers: a hot key is spread over tasks and never one array.
    """
    step = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    if "_range" in df.columns:
        ranged = df.select(key, F.col(order).alias("_o"), "_range", step.alias("_s"))
    else:
        ranged = in_ranges(df.select(key, F.col(order).alias("_o"), step.alias("_s")), [key, "_o"], rows)

    def fold(by: list[str], pos: str, src: DataFrame) -> DataFrame:
        got = src.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("o"), F.col("_s").alias("s")))).alias("_l"), F.sum("_n").alias("_n"))
        return got.withColumn("_s", _compose(F.transform("_l", lambda x: x["s"]))).drop("_l")

    ranges = fold([key, "_range"], "_o", ranged.withColumn("_n", F.lit(1)))
    whole = fold([key], "_range", ranges)
    s = F.col("_s")
    return whole.select(key, F.least(F.greatest(s["a"] * start + s["b"], s["lo"]), s["hi"]).alias("state"), F.col("_n").alias("n"))


def q_values(df: DataFrame, key: str, order: str, reward: Column, rate: float = 0.2, start: float = 0.5) -> DataFrame:
    """q + rate (r - q) in order, within 0 and 1."""
    return ordered_fold(df, key, order, F.lit(1.0 - rate), rate * reward, 0.0, 1.0, start)


def touches(df: DataFrame, key: str, order: str, time: str, decay: float = 0.05, alpha: float = 0.5, base: float = 5.0) -> DataFrame:
    """Saliency after a key's touches: the score decays by the days since the last one, then rises by alpha ln 2, within 1 and 10."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    ranged = in_ranges(df.select(key, order, seconds.alias("_seconds")), [key, order])
    ends = ranged.groupBy(key, "_range").agg(F.max_by("_seconds", order).alias("_last"))
    carried = ends.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), F.lag("_last").over(Window.partitionBy(key).orderBy("_range")).alias("_carried"))  # a row a range
    before = F.coalesce(F.lag("_seconds").over(Window.partitionBy(key, "_range").orderBy(order)), F.col("_carried"))
    joined = ranged.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    days = F.greatest(F.coalesce(F.col("_seconds") - before, F.lit(0.0)), F.lit(0.0)) / 86400.0
    timed = joined.withColumn("_days", days)
    return ordered_fold(timed, key, order, F.exp(-decay * F.col("_days")), alpha * F.log1p(F.lit(1.0)), 1.0, 10.0, base)


#: Scales of neighbours by direction.
DIRECTION_SCALE = {"out": 1.0, "in": 0.25}


def neighbour_weights(edges: DataFrame, per_direction: int) -> DataFrame:
    """(src, dst, weight): the first neighbours of each direction by name with scale / (rank + 1); the better direction counts."""
    out = edges.select("src", "dst", F.lit("out").alias("d"))
    both = out.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("in").alias("d"))).distinct()
    w = Window.partitionBy("src", "d").orderBy("dst")
    scale = F.when(F.col("d") == "out", DIRECTION_SCALE["out"]).otherwise(DIRECTION_SCALE["in"])
    ranked = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_direction)  # a hub is cut before the shuffle
    return ranked.groupBy("src", "dst").agg(F.max(scale / F.col("r")).alias("weight"))


def coactivation(edges: DataFrame, touched: DataFrame, per_direction: int, hops: int = 2, hop_decay: float = 0.5, budget: int = 50) -> DataFrame:
    """(origin, node, hop, weight) that touches of ``touched`` (node) spread to; the budget is used hop by hop, by weight and name."""
    near = cut(neighbour_weights(edges, per_direction), "neighbours")
    front = touched.select(F.col("node").alias("origin"), "node", F.lit(1.0).alias("weight")).distinct()
    seen, out = front.select("origin", "node", F.lit(0).alias("hop"), "weight"), None
    for hop in range(1, min(max(hops, 1), 2) + 1):
        scale = 1.0 if hop == 1 else hop_decay
        step = front.join(near.withColumnRenamed("weight", "w"), F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"), (F.col("weight") * scale * F.col("w")).alias("weight"))
        step = step.groupBy("origin", "node").agg(F.max("weight").alias("weight")).join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        used = seen.where("hop > 0").groupBy("origin").agg(F.count("*").alias("used"))
        w = Window.partitionBy("origin").orderBy(F.desc("weight"), "node")
        kept = step.withColumn("r", F.row_number().over(w)).join(used, "origin", "left").where(F.col("r") + F.coalesce("used", F.lit(0)) <= budget)
        front = kept.select("origin", "node", "weight")
        seen = seen.unionByName(front.select("origin", "node", F.lit(hop).alias("hop"), "weight"))
        out = seen
    return out.where("hop > 0")


def two_phase_recall(df: DataFrame, key: str, similarity: Column, q: Column, first: int = 20, last: int = 5, mix: float = 0.3) -> DataFrame:
    """The ``first`` most similar rows, then the ``last`` best by (1 - mix) similarity + mix q; ties go to the smaller key."""
    near = df.select(key, similarity.alias("similarity"), q.alias("q")).orderBy(F.desc("similarity"), key).limit(first)
    return near.withColumn("score", (1 - mix) * F.col("similarity") + mix * F.col("q")).orderBy(F.desc("score"), key).limit(last)


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def ledger(df: DataFrame, uses: Column, success: Column, failure: Column, outcome: Column, q: Column, react: Column, graph: Column, omega: Column) -> DataFrame:
    """Adds usage_count, failure_rate, ttl_score and utility_score of an episode."""
    feedback = success + failure
    rate = F.when(feedback == 0, F.when(F.lower(outcome) == "error", 1.0).otherwise(0.0)).otherwise(_unit(failure / F.nullif(feedback, F.lit(0))))
    often = F.when(uses == 0, 0.0).otherwise(uses / (uses + 3.0))
    ttl = 0.45 * often + 0.35 * (1.0 - F.col("failure_rate")) + 0.20 * (success + 1.0) / (feedback + 2.0)
    utility = 0.32 * _unit(react) + 0.23 * _unit(graph) + 0.25 * _unit(omega) + 0.20 * _unit(q)
    return df.withColumn("usage_count", uses).withColumn("failure_rate", rate).withColumn("ttl_score", _unit(ttl)).withColumn("utility_score", _unit(utility))


#: Fixed values of the gate: thresholds of promotion and of obsolescence.
PROMOTE = {"utility": 0.78, "uses": 3, "failure_rate": 0.25, "ttl": 0.50}
OBSOLETE = {"utility": 0.32, "uses": 2, "failure_rate": 0.70, "ttl": 0.45}


def gate(df: DataFrame) -> DataFrame:
    """Adds verdict (promote, obsolete, retain) and confidence to a ledger."""
    n, u, f, t = (F.col(c) for c in ("usage_count", "utility_score", "failure_rate", "ttl_score"))
    p, o = PROMOTE, OBSOLETE
    up = (n >= p["uses"]) & (u >= p["utility"]) & (f <= p["failure_rate"]) & (t >= p["ttl"])
    down = (n >= o["uses"]) & (u <= o["utility"]) & (f >= o["failure_rate"]) & (t <= o["ttl"])
    zero = F.lit(0.0)
    sure_up = _unit(0.55 + F.greatest(u - p["utility"], zero) * 1.8 + F.greatest(p["failure_rate"] - f, zero) * 0.8)
    sure_down = _unit(0.55 + F.greatest(o["utility"] - u, zero) * 1.8 + F.greatest(f - o["failure_rate"], zero) * 0.8)
    between = F.least(0.42 + F.least(F.abs(p["utility"] - u), F.abs(u - o["utility"])) * 0.6, F.lit(0.85))
    return df.withColumn("verdict", F.when(up, "promote").when(down, "obsolete").otherwise("retain")).withColumn("confidence", F.when(up, sure_up).when(down, sure_down).otherwise(between))


def feedback_bias(df: DataFrame, key: str, order: str, delta: Column, keep: float = 0.85) -> DataFrame:
    """Moving average keep p + (1 - keep) d in order, from 0."""
    return ordered_fold(df, key, order, F.lit(keep), (1 - keep) * delta, float("-inf"), float("inf"), 0.0)


def halt_points(df: DataFrame, key: str, order: str, score: Column, floor: float, run: int = 3) -> DataFrame:
    """The first row of each stream at which the mean of the last ``run`` scores lies under a floor."""
    w = Window.partitionBy(key).orderBy(order)
    last = w.rowsBetween(1 - run, 0)
    marked = df.withColumn("_m", F.avg(score).over(last)).withColumn("_c", F.count("*").over(last)).where((F.col("_c") == run) & (F.col("_m") < floor))
    return marked.groupBy(key).agg(F.min(order).alias("halt_at"))




def last_turns(turns: DataFrame, session: str, order: str, n: int) -> DataFrame:
    """The last ``n`` turns of each session, 0 the oldest of them: what a ring of that size holds."""
    w = Window.partitionBy(session)
    kept = turns.withColumn("_r", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("_r") <= n)
    return kept.withColumn("slot", F.row_number().over(w.orderBy(order)) - 1).drop("_r")


def drained(turns: DataFrame, session: str, order: str, n: int) -> DataFrame:
    """The oldest ``n`` turns of each session."""
    return turns.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(order))).where(F.col("_r") <= n).drop("_r")


#: From which bias on a plan widens or narrows, and by how much at full strength.
WIDEN_FROM, NARROW_FROM, STRONG = -0.25, 0.35, 0.7


def tuned_plan(bias: Column, k1: Column, k2: Column, mix: Column, min_score: Column, chars: Column) -> Column:
    """A struct of the recall plan (k1, k2, mix, min_score, chars) that feedback has widened or narrowed; k2 is 1 to k1."""
    b = F.when(F.isnan(bias) | bias.isNull(), 0.0).otherwise(F.least(F.greatest(bias, F.lit(-1.0)), F.lit(1.0)))
    strength = F.abs(b)
    step = F.when(strength >= STRONG, 2).otherwise(1)
    unit = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    wide_2 = k2 + step
    wide = F.struct(F.greatest(k1 + 3 * step, wide_2).alias("k1"), wide_2.alias("k2"), unit(mix - 0.06 * strength, 0.0, 1.0).alias("mix"), unit(min_score - 0.05 * strength, 0.01, 1.0).alias("min_score"), unit(chars + F.round(240 * strength).cast("int"), 320, 2400).alias("chars"))
    few_2 = F.greatest(k2 - step, F.lit(1))
    few = F.struct(F.greatest(k1 - 2 * step, few_2).alias("k1"), few_2.alias("k2"), unit(mix + 0.05 * strength, 0.0, 1.0).alias("mix"), unit(min_score + 0.04 * strength, 0.01, 0.35).alias("min_score"), unit(chars - F.round(160 * strength).cast("int"), 320, 2400).alias("chars"))
    same = F.struct(k1.alias("k1"), k2.alias("k2"), mix.cast("double").alias("mix"), min_score.cast("double").alias("min_score"), chars.alias("chars"))
    plan = F.when(b <= WIDEN_FROM, wide).when(b >= NARROW_FROM, few).otherwise(same)
    k = F.greatest(plan["k1"], F.lit(1))
    return F.struct(k.alias("k1"), F.least(F.greatest(plan["k2"], F.lit(1)), k).alias("k2"), plan["mix"].alias("mix"), plan["min_score"].alias("min_score"), plan["chars"].alias("chars"))


def decided(log: DataFrame, key: str, order: str, state: str, start: str = "provisional", final: tuple[str, ...] = ("promoted", "rejected")) -> DataFrame:
    """(key, state, at): what an append log of suggestions and decisions comes to.

    Only a suggestion that is still open can be decided, so the first decision after its first suggestion counts, of equal times that which comes first in the alphabet.
    """
    opened = log.where(F.col(state) == start).groupBy(key).agg(F.min(order).alias("opened"))
    decisions = log.where(F.col(state).isin(*final)).select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(state).alias("_s"))
    first = opened.join(decisions, (F.col(key) == F.col("_k")) & (F.col("_o") > F.col("opened")), "left").groupBy(key, "opened").agg(F.min_by("_s", F.struct("_o", "_s")).alias("_s"), F.min("_o").alias("_o"))
    return first.select(key, F.coalesce("_s", F.lit(start)).alias("state"), F.coalesce("_o", "opened").alias("at"))


#: Rows whose states are stepped through as one array.
STEP_ROWS = 256


def transitions(log: DataFrame, key: str, order: str, action: str, rules: dict[tuple[str, str], str], start: str, rows: int = RANGE_ROWS, step: int = STEP_ROWS) -> DataFrame:
    """``log`` with ``before``, ``after`` and ``legal``: the states that a key passes by ``rules`` (state, action) -> state.

    An action without a rule is illegal and leaves the state.  What a row does is a map of the states to states; maps
    compose, so a key's rows are composed in steps of ``step`` rows and ranges of about ``rows`` first, and the state at
    the beginning of each range, step and row is found from above: a hot key is spread over tasks and never one array.
    ``order`` is unique in a key.
    """
    states = list(dict.fromkeys([start, *[s for s, _ in rules], *rules.values()]))
    number = {s: i for i, s in enumerate(states)}
    known = sorted({a for _, a in rules})
    whole = F.array(*[F.lit(i) for i in range(len(states))])
    step_map = F.element_at(F.create_map(*[x for a in known for x in (F.lit(a), F.array(*[F.lit(number[rules.get((s, a), s)]) for s in states]))]), F.col(action))
    log = log.withColumn("_row", F.struct(*log.columns))
    ranged = in_ranges(log.select("_row", F.col(key).alias("_k"), F.col(order).alias("_o"), F.coalesce(step_map, whole).alias("_m")), ["_k", "_o"], rows)
    at = F.row_number().over(Window.partitionBy("_k", "_range").orderBy("_o")) - 1
    stepped = cut(ranged.withColumn("_step", F.floor(at / step)), "steps")

    def composed(df: DataFrame, by: list[str], pos: str) -> DataFrame:
        """The maps of each group as one."""
        got = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("o"), F.col("_m").alias("m")))).alias("_l"))
        return got.select(*by, F.aggregate("_l", whole, lambda acc, x: F.transform(acc, lambda s: F.get(x["m"], s))).alias("_m"))

    def begun(df: DataFrame, by: list[str], pos: str, more: str | None, first: Column) -> DataFrame:
        """(by, pos, _s): the state at the beginning of each member of a group, whose own beginning is ``first``."""
        fields = [F.col(pos).alias("o"), F.col("_m").alias("m"), *([F.col(more).alias("row")] if more else [])]
        got = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_l"), F.first(first).alias("_first"))
        zero = F.struct(F.col("_first").alias("s"), F.array().cast("array<int>").alias("out"))
        scan = F.aggregate("_l", zero, lambda acc, x: F.struct(F.get(x["m"], acc["s"]).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")))
        each = got.select(*by, F.explode(F.arrays_zip(F.col("_l").alias("l"), scan["out"].alias("s"))).alias("e"))
        return each.select(*by, F.col("e.l.o").alias(pos), F.col("e.s").alias("_s"), *([F.col("e.l.m").alias("_m"), F.col("e.l.row").alias(more)] if more else []))

    steps = cut(composed(stepped, ["_k", "_range", "_step"], "_o"), "step-maps")
    ranges = composed(steps, ["_k", "_range"], "_step")
    of_range = begun(ranges, ["_k"], "_range", None, F.lit(number[start]))
    in_range = lambda df, s: df.join(s.withColumnsRenamed({"_k": "_k2", "_range": "_range2", "_s": "_s2"}), F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_range") == F.col("_range2"))).drop("_k2", "_range2")
    of_step = begun(in_range(steps, of_range), ["_k", "_range"], "_step", None, F.col("_s2"))
    of_step = of_step.withColumnsRenamed({"_k": "_k2", "_range": "_range2", "_step": "_step2", "_s": "_s2"})
    met = stepped.join(of_step, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_range") == F.col("_range2")) & (F.col("_step") == F.col("_step2")))
    each = begun(met, ["_k", "_range", "_step"], "_o", "_row", F.col("_s2"))
    names = F.array(*[F.lit(s) for s in states])
    legal = F.array_contains(F.array(*[F.lit(f"{s}\0{a}") for s, a in rules]), F.concat_ws("\0", F.get(names, F.col("_s")), F.col(f"_row.{action}")))
    return each.select("_row.*", F.get(names, F.col("_s")).alias("before"), F.get(names, F.get("_m", F.col("_s"))).alias("after"), legal.alias("legal"))


class Builds:
    """Which corpora are built, by fingerprint: a build runs under a lease of an epoch, and only its holder may end it."""

    def __init__(self) -> None:
        self.done: dict[str, str] = {}
        self.running: dict[str, tuple[str, int]] = {}
        self.progress: dict[str, float] = {}
        self.epoch = 0

    def begin(self, corpus: str, fingerprint: str) -> int | None:
        """The lease of a new build; None if this fingerprint is built or being built.  A new fingerprint takes the lease over."""
        if self.done.get(corpus) == fingerprint or self.running.get(corpus, ("", 0))[0] == fingerprint:
            return None
        self.epoch += 1
        self.running[corpus], self.progress[corpus] = (fingerprint, self.epoch), 0.0
        return self.epoch

    def report(self, corpus: str, lease: int, share: float) -> bool:
        if self.running.get(corpus, ("", 0))[1] != lease:
            return False
        self.progress[corpus] = min(1.0, max(self.progress[corpus], share))
        return True

    def finish(self, corpus: str, lease: int, ok: bool = True) -> bool:
        if self.running.get(corpus, ("", 0))[1] != lease:
            return False
        fingerprint, _ = self.running.pop(corpus)
        if ok:
            self.done[corpus], self.progress[corpus] = fingerprint, 1.0
        return True
