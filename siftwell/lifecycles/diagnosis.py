"""From record shards to a verdict: grouped metrics, greatest tokens, criteria and report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import arrays as A
from siftwell.functions import text as X
from siftwell.functions.stats import histogram, spearman
from siftwell.lifecycles.records import BIAS, FILE_ORDER, MATH, YES_NO, with_lengths
from siftwell.operators import aggregates as G
from siftwell.operators.joins import teacher_student
from siftwell.operators.sampling import explode_tokens, top_per_group
from siftwell.plans.gates import criteria_verdict

#: Reports name a topic's group so.
TOPIC_GROUP = "vlmbias_main / "


def grouped(records: DataFrame) -> DataFrame:
    """Each record once for its group and, of bias records, once for its topic; records of no group are left out."""
    topic = F.when((F.col("group") == BIAS) & F.col("topic").isNotNull(), F.concat(F.lit(TOPIC_GROUP), "topic"))
    return records.withColumn("group", F.explode(F.array_compact(F.array("group", topic))))


def _renamed(df: DataFrame, struct: str, names: dict[str, str]) -> DataFrame:
    return df.select("group", F.struct(*[F.col(a).alias(b) for a, b in names.items()]).alias(struct))


def gains(rows: DataFrame, *by: str, lengths: bool, finite_only: bool = False) -> DataFrame:
    """Mean gains of truth and bias by group, per token where lengths are known, with the names of the reports."""
    cols = ("n_gt_tokens", "n_bias_tokens") if lengths else None
    out = G.visual_gain(rows, *by, finite_only=finite_only, lengths=cols)
    names = {"n_gt": "n_gt", "n_bias": "n_bias", "gain_gt": "mean_gain_ground_truth", "gain_bias": "mean_gain_expected_bias", "margin": "gain_margin"}
    if not lengths:
        return out.select(*by, *[F.col(a).alias(b) for a, b in names.items()])
    names |= {"gain_gt_per_token": "mean_gain_per_tok_ground_truth", "gain_bias_per_token": "mean_gain_per_tok_expected_bias", "margin_per_token": "gain_margin_lengthnorm"}
    missed = lambda option, n: (F.try_element_at("opt_i", F.lit(option)).isNotNull() & F.try_element_at("opt_null", F.lit(option)).isNotNull() & F.col(n).isNull()).cast("int")
    skipped = rows.groupBy(*by).agg(F.coalesce(F.sum(missed("ground_truth", cols[0]) + missed("expected_bias", cols[1])), F.lit(0)).alias("n_skipped_lengthnorm"))
    joined = out.join(skipped, list(by)) if by else out.join(skipped)  # without by one row each
    return joined.select(*by, *[F.col(a).alias(b) for a, b in names.items()], "n_skipped_lengthnorm")


def metrics(teacher: DataFrame, student: DataFrame, count: Callable[[str], int] | None = None) -> DataFrame:
    """A row for each group: structs of accuracy, mean deltas, gains, overlap with the student and grounding.

    teacher and student are prepared records. Bias groups have gains and overlap, yes/no groups grounding; elsewhere these are null.
    """
    rows = grouped(with_lengths(teacher, count))
    bias = F.col("group").startswith(BIAS)
    acc = _renamed(G.accuracy(rows, "group", with_image="correct"), "m1_acc", {"n": "n", "acc_i": "acc_I", "acc_null": "acc_null", "delta_acc": "delta_acc"})
    known = rows.where("mean_delta IS NOT NULL").select("group", "correct", "mean_delta")
    rho = spearman(known.withColumn("right", F.col("correct").cast("int")), "mean_delta", "right", ["group"])
    means = G.split_means(known, "mean_delta", "correct", "group").join(rho, "group", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    means = acc.select("group").join(means, "group", "left").select("group", F.struct(
        none("n").alias("n_with_delta"), none("n_correct").alias("n_correct"), none("n_wrong").alias("n_wrong"), F.col("mean_correct").alias("mean_delta_correct"),
        F.col("mean_wrong").alias("mean_delta_wrong"), F.col("gap").alias("delta_gap"), F.col("rho").alias("spearman_delta_correctness")).alias("m2_mean_delta"))
    gain = gains(rows.where(bias), "group", lengths=count is not None)
    gain = gain.select("group", F.struct(*[c for c in gain.columns if c != "group"]).alias("m3_visual_gain"))
    overlap = _overlap(rows.where(bias), grouped(student).where(bias), acc.where(bias).select("group"))
    yes_no = rows.where((F.col("group") == YES_NO) & F.col("mean_delta").isNotNull() & X.canonical(F.col("gold")).isin("yes", "no"))
    ground = G.grounding_gap(yes_no.select("group", "mean_delta", X.canonical(F.col("text")).alias("answer"), X.canonical(F.col("gold")).alias("gold")), "mean_delta", "group")
    ground = _renamed(ground, "m5b_hallucinated_grounded", {"n_grounded": "n_grounded", "n_hallucinated": "n_hallucinated", "grounded": "mean_delta_grounded", "hallucinated": "mean_delta_hallucinated", "gap": "delta_gap"})
    out = acc
    for part in (means, gain, overlap, ground):
        out = out.join(part, "group", "left")
    return out


def _overlap(teacher: DataFrame, student: DataFrame, groups: DataFrame) -> DataFrame:
    """Overlap of wrong answers within each group; a group that matches no student row has zero counts."""
    paired = teacher.withColumn("key", F.struct("group", "sample_id"))
    others = student.select(F.struct("group", "sample_id").alias("key"), "answer", "correct", *FILE_ORDER)
    found = G.error_overlap(teacher_student(paired, others, "key", FILE_ORDER), "group")
    none = lambda c: F.coalesce(c, F.lit(0))
    return groups.join(found, "group", "left").select("group", F.struct(
        none("both_wrong").alias("n_both_wrong"), none("same_wrong").alias("n_same_wrong"), F.col("same_rate").alias("overlap_rate"), none("answer_space").alias("answer_space_size"),
        F.col("chance").alias("chance_baseline"), F.col("excess").alias("excess_over_chance")).alias("m5a_student_teacher_overlap"))


def best_tokens(records: DataFrame, *by: str, n: int) -> DataFrame:
    """By group the n samples whose greatest token value is greatest, each with its first greatest token."""
    at = A.first_argmax(F.col("deltas")).cast("int")
    best = records.where(F.size("deltas") > 0).select(*by, F.get("tokens", at).alias("token"), F.get("deltas", at).alias("delta"), F.col("sample_id").alias("context_sample_id"))
    return _first(best, by, n, F.col("context_sample_id"))


def all_tokens(records: DataFrame, *by: str, n: int) -> DataFrame:
    """By group the n greatest token values, however many are of one sample."""
    rows = explode_tokens(records, *by, "sample_id").select(*by, "token", F.col("value").alias("delta"), F.col("sample_id").alias("context_sample_id"), "pos")
    return _first(rows, by, n, F.col("context_sample_id"), F.col("pos")).drop("pos")


def _first(rows: DataFrame, by: Sequence[str], n: int, *ties: Column) -> DataFrame:
    return top_per_group(rows, by[0], [F.desc("delta"), *ties], n)


def token_lists(records: DataFrame, n: int = 50, n_topic: int = 20) -> dict:
    """The named lists of greatest tokens; each holds at most n or, by topic, n_topic entries."""
    mine = records.where("group IS NOT NULL")
    names = {BIAS: "vlmbias", YES_NO: "pope_adversarial", MATH: "mathvista_mini"}
    order = lambda rows: sorted(rows, key=lambda r: (-r.delta, r.context_sample_id))
    entries = lambda rows: [{"token": r.token, "delta": r.delta, "context_sample_id": r.context_sample_id} for r in order(rows)]
    best, every = best_tokens(mine, "group", n=n).collect(), all_tokens(mine, "group", n=n).collect()
    topics = best_tokens(mine.where((F.col("group") == BIAS) & F.col("topic").isNotNull()), "topic", n=n_topic).collect()
    out = {f"{name}_dedup_by_sample": entries([r for r in best if r.group == g]) for g, name in names.items()}
    out["vlmbias_by_topic"] = {t: entries([r for r in topics if r.topic == t]) for t in sorted({r.topic for r in topics})}
    return out | {f"{name}_raw_top{n}": entries([r for r in every if r.group == g]) for g, name in names.items()}


def verdict(groups: DataFrame) -> DataFrame:
    """One row: the automatic criteria c1, c2, c3 and c5b with the verdict. Gains per token go before plain ones where they are known."""
    gain = groups.schema["m3_visual_gain"].dataType.names
    margin = F.col("bias.m3_visual_gain.gain_margin")
    if "gain_margin_lengthnorm" in gain:
        margin = F.coalesce("bias.m3_visual_gain.gain_margin_lengthnorm", margin)
    pick = lambda g: F.max(F.when(F.col("group") == g, F.struct(*groups.columns)))
    one = groups.agg(pick(BIAS).alias("bias"), pick(YES_NO).alias("yes_no"))
    return criteria_verdict(one, {
        "c1": F.col("bias.m1_acc.delta_acc") > 0, "c2": (F.col("bias.m2_mean_delta.delta_gap") > 0) & (F.col("bias.m2_mean_delta.spearman_delta_correctness") > 0),
        "c3": margin > 0, "c5b": F.col("yes_no.m5b_hallucinated_grounded.delta_gap") > 0})


def report(groups: DataFrame, n_groups: int = 1000) -> str:
    """Markdown: the decision, each criterion, topics from best to worst margin, the other groups. More groups than n_groups raise."""
    rows = groups.limit(n_groups + 1).collect()
    if len(rows) > n_groups:
        raise ValueError(f"a report holds at most {n_groups} groups")
    said = verdict(groups.sparkSession.createDataFrame(rows, groups.schema)).first()
    show = lambda v: "-" if v is None else f"{v:+.4f}" if isinstance(v, float) else str(v)
    checks = {"c1": "image raises accuracy", "c2": "mean delta is higher where right, and ranks with it", "c3": "image favours the truth over the bias", "c5b": "mean delta is higher for grounded than for hallucinated yes"}
    lines = ["# Verdict", "", f"**{said.verdict}**: {said.n_met} of the automatic criteria hold; the greatest tokens are left to manual review.", ""]
    lines += [f"- {'met' if said[k] else 'not known' if said[k] is None else 'not met'}: {what}" for k, what in checks.items()]
    lengths = "gain_margin_lengthnorm" in groups.schema["m3_visual_gain"].dataType.names
    key = lambda r: (r.m3_visual_gain.gain_margin_lengthnorm if lengths else None) or r.m3_visual_gain.gain_margin or 0.0
    lines += ["", "| group | n | acc_I | acc_null | delta_acc | gain_margin |" + (" per token |" if lengths else ""), "|---|---|---|---|---|---|" + ("---|" if lengths else "")]
    topics = sorted((r for r in rows if r.group.startswith(TOPIC_GROUP)), key=key, reverse=True)
    for r in [*topics, *(r for r in rows if not r.group.startswith(TOPIC_GROUP))]:
        gain = r.m3_visual_gain
        cells = [r.group, r.m1_acc.n, r.m1_acc.acc_I, r.m1_acc.acc_null, r.m1_acc.delta_acc, gain and gain.gain_margin, *([gain and gain.gain_margin_lengthnorm] if lengths else [])]
        lines.append("| " + " | ".join(map(show, cells)) + " |")
    return "\n".join([*lines, ""])


def figures(records: DataFrame, bins: int = 60) -> dict[str, DataFrame]:
    """The data of three figures: paired margins by topic, and densities of mean deltas by correctness and by grounding."""
    bias = records.where(F.col("group") == BIAS)
    margins = G.paired_margin(bias.where("topic IS NOT NULL"), "topic").select("topic", F.col("n_gt").alias("n"), "gain_gt", "gain_bias", "margin")
    yes = records.where((F.col("group") == YES_NO) & X.says_yes(X.canonical(F.col("text"))) & X.canonical(F.col("gold")).isin("yes", "no"))
    return {
        "margins": margins,
        "delta_by_correctness": _densities(bias, F.when(F.col("correct"), "correct").otherwise("wrong"), bins),
        "delta_by_grounding": _densities(yes, F.when(X.canonical(F.col("gold")) == "yes", "grounded").otherwise("hallucinated"), bins - 10),
    }


def _densities(rows: DataFrame, side: Column, bins: int) -> DataFrame:
    """(side, bin, n, density) over equal widths from 0 to the greatest mean delta of both sides."""
    known = rows.where("mean_delta IS NOT NULL").select(side.alias("side"), "mean_delta")
    top = known.agg(F.max("mean_delta")).first()[0]
    hi = top if top and top > 0 else 1.0
    both = None
    for name in [r.side for r in known.select("side").distinct().orderBy("side").collect()]:  # two at most
        part = histogram(known.where(F.col("side") == name), "mean_delta", 0.0, hi, bins).select(F.lit(name).alias("side"), "bin", "n", "density")
        both = part if both is None else both.unionByName(part)
    return both if both is not None else rows.sparkSession.createDataFrame([], "side string, bin bigint, n bigint, density double")
