"""Requests to a teacher model by phase of the lane change, in own wording, and the records that supervised training takes.

A row has status (0 anticipation, 1 crossing, 2 relaxation), ego, and tl, tf, tff, ol, of: the leader, follower and second follower in the lane aside, and leader and
follower in the own lane, each a struct of first and last frame with x, y, v, lat_v, acc, yaw and lane_u, or null where there is none.
All is column expressions but the texts of numbers, for which a row goes to Python twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import only_split
from ..operators.lineage import assert_no_future
from . import kinematics as K
from .prompts import exact_texts
from .text import PHASES, STRATEGIES

MERGE, RELAX = STRATEGIES[:6], STRATEGIES[6:]
#: Names and roles of neighbours.
NAMES = {"tl": "Leader aside", "tf": "Follower aside", "tff": "Second follower aside", "ol": "Leader in lane", "of": "Follower in lane"}
#: The keys that an answer must have, by phase.
DECISION = (("aggressiveness", "risk_tolerance", "lateral_intent", "longitudinal_intent", "confidence"), ("lateral_intent", "longitudinal_intent", "stability_level", "confidence"))


def answer_form(phase: int) -> str:
    """What the answer has to look like: one JSON object that answers.strategy_answer reads."""
    pool, numbers = (RELAX, DECISION[1]) if phase == 2 else (MERGE, DECISION[0])
    gap = "" if phase == 2 else ', "target_gap": GAP1, GAP2 or EITHER'
    scores = ", ".join(f'"{s}"' for s in pool)
    return (
        f'Reply with one JSON object: "phase": "{PHASES[phase].upper()}"; "reasoning": short texts; "decision": {{"primary_strategy": one of the names below{gap}, '
        f'"strategy_scores": {{a number from 0 to 1 for each of {scores}}}, {", ".join(chr(34) + n + chr(34) for n in numbers)}: numbers}}; '
        '"prediction_guidance": {"expected_speed_change": ACCEL, KEEP or DECEL, "key_interaction": OL, OF, TL, TF, TFF or NONE}.'
    )


def facts(ego: Column, other: Column, role: str, length: float, width: float) -> Column:
    """Struct of what a request says of a neighbour: the interaction now, and the gap a second ago and its trend, in the order of now. Null for none."""
    now = K.interaction(ego["last"], other["last"], F.lit(f"phys_{role}"), length, width)
    ahead = other["last"]["x"] > ego["last"]["x"]
    before = F.when(ahead, K.gap_clear(other["first"]["x"], ego["first"]["x"], length)).otherwise(K.gap_clear(ego["first"]["x"], other["first"]["x"], length))
    trend = K.banded(now["gap"] - before, K.GAP_BAND, "opening", "closing", "stable")
    reaction = K.banded(other["last"]["acc"] - other["first"]["acc"], K.ACC_BAND, "rising", "falling", "flat")
    made = F.struct(
        now["gap"].alias("gap"), before.alias("before"), trend.alias("trend"), ahead.alias("ahead"), now["dy"].alias("dy"), now["dv"].alias("dv"), now["ttc"].alias("ttc"), now["risk"].alias("risk"),
        other["last"]["v"].alias("v"), other["last"]["acc"].alias("acc"), K.side_class(now["gap"], ahead).alias("side"), reaction.alias("reaction"), K.style(other["last"]["acc"], other["last"]["v"]).alias("style"),
    )
    return F.when(ego.isNotNull() & other.isNotNull(), made)


def between(front: Column, rear: Column, length: float) -> Column:
    """Struct of the gap between two neighbours now and its trend; null unless both are there and the leader is ahead."""
    now = K.gap_clear(front["last"]["x"], rear["last"]["x"], length)
    before = K.gap_clear(front["first"]["x"], rear["first"]["x"], length)
    pair = K.gap_between(front["last"], rear["last"], length)
    made = F.struct(now.alias("gap"), K.banded(now - before, K.GAP_BAND, "opening", "closing", "stable").alias("trend"), pair["ttc"].alias("ttc"), (rear["last"]["v"] - front["last"]["v"]).alias("dv"))
    return F.when(pair.isNotNull(), made)


def with_request(rows: DataFrame, out: str = "request", length: float = 4.8, width: float = 1.9) -> DataFrame:
    """rows with a request by phase, null without an ego or with another status. Of the neighbours the first three count before and in the crossing, all but
    the third after it."""
    d = rows.withColumns({f"_{r}": facts(F.col("ego"), F.col(r), r, length, width) for r in NAMES})
    d = d.withColumns({"_gap1": between(F.col("tl"), F.col("tf"), length), "_gap2": between(F.col("tf"), F.col("tff"), length)})
    first, last = (lambda c: F.col(f"ego.first.{c}")), (lambda c: F.col(f"ego.last.{c}"))
    progress = K.progress(F.col("status"), last("lane_u"), last("lat_v"))
    # numbers of two decimals and of three, each kind in one array
    two = {"v0": first("v"), "v": last("v"), "a0": first("acc"), "a": last("acc"), "u0": first("lane_u"), "u": last("lane_u"), "part": progress, "safe": 1.5 * last("v"), "g1": F.col("_gap1.gap"), "g2": F.col("_gap2.gap"), "g2dv": F.col("_gap2.dv"), "g2ttc": F.col("_gap2.ttc")}
    two |= {f"{r}_{c}": F.col(f"_{r}.{c}") for r in NAMES for c in ("gap", "before", "dy", "dv", "ttc", "v", "acc")}
    three = {"l0": first("lat_v"), "l": last("lat_v"), "y0": first("yaw"), "y": last("yaw")}
    real = lambda c: c.cast("double")
    d = d.withColumn("_two", exact_texts(F.array(*map(real, two.values())), 2)).withColumn("_three", exact_texts(F.array(*map(real, three.values())), 3))
    t = {k: F.coalesce(F.get("_two", F.lit(i)), F.lit("unknown")) for i, k in enumerate(two)} | {k: F.coalesce(F.get("_three", F.lit(i)), F.lit("unknown")) for i, k in enumerate(three)}

    def line(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    speed = K.banded(last("v") - first("v"), 0.0, "increasing", "decreasing", "stable")
    settled = K.settling(last("lat_v"), last("yaw"))
    own = [
        line("Own speed: ", t["v0"], " to ", t["v"], " m/s (", speed, "); acceleration ", t["a0"], " to ", t["a"], " m/s^2, driving ", K.style(last("acc"), last("v")), "."),
        line("Sideways: ", t["l0"], " to ", t["l"], " m/s (", K.drift(last("lane_u"), last("lat_v")), "); heading ", t["y0"], " to ", t["y"], " rad (", K.pointing(last("yaw")), ")."),
    ]

    def neighbour(r: str, absent: str) -> Column:
        f = F.col(f"_{r}")
        said = line(f"{NAMES[r]}: ", f["side"], ", gap ", t[f"{r}_before"], " to ", t[f"{r}_gap"], " m (", f["trend"], "), ", t[f"{r}_dy"], " m aside, speed ", t[f"{r}_v"], " m/s (dv ", t[f"{r}_dv"], "), closing time ", t[f"{r}_ttc"], " s, acceleration ", f["reaction"], ", driving ", f["style"], ", risk ", f["risk"], ".")
        return F.when(f.isNull(), f"{NAMES[r]}: none, {absent}.").otherwise(said)

    side = K.side_flags(F.col("_tl.gap"), F.col("_tl.ahead"))
    reach = K.reach(F.when(F.col("_tf.ahead"), F.lit(-1.0)).otherwise(F.col("_tf.gap")), F.col("_tf").isNotNull())
    gap = lambda name, g, who: F.when(F.col(g).isNull(), f"{name} ({who}): none.").otherwise(line(f"{name} ({who}): ", t["g1" if g == "_gap1" else "g2"], " m, ", F.col(f"{g}.trend"), "."))
    merge = [
        neighbour("tl", "the lane is open ahead"), F.when(F.col("_tl").isNotNull(), line("Position against it: ", F.when(side["advantage"], "of advantage").otherwise("none"), ".")),
        neighbour("tf", "nothing closes from behind"), neighbour("tff", "the gap behind is open"), line(gap("Gap 1", "_gap1", "between leader and follower"), " Way in: ", reach, "."), gap("Gap 2", "_gap2", "between the followers"),
        F.when(F.col("_gap2").isNotNull(), line("Pressure in gap 2: dv ", t["g2dv"], " m/s, closing time ", t["g2ttc"], " s.")),
    ]
    follow = F.when(F.col("_ol").isNotNull(), line("Distance kept: ", K.following(F.col("_ol.gap"), last("v")), ", advised ", t["safe"], " m."))
    after = [
        line("Motion: ", F.when(settled["moving"], "still sideways").otherwise("steady in the lane"), ", heading ", F.when(settled["turned"], "not along it yet").otherwise("along it"), "."),
        neighbour("ol", "the lane is open ahead"), follow, neighbour("of", "nothing closes from behind"), neighbour("tl", "nothing there"), neighbour("tf", "nothing there"),
    ]
    before = line("Boundary: ", t["u0"], " to ", t["u"], " m away; done of the change: ", t["part"], ".")
    why = ("It keeps its lane and wants to the left before the blocked part of the road.", "It is over the boundary of the lanes.", "It has come into the new lane and has to settle there.")

    def request(phase: int) -> Column:
        head = [F.lit(f"Phase: {PHASES[phase].upper()}"), F.lit(f"A vehicle changes lanes in dense traffic behind a crash. {why[phase]} Say what it will do in the next 3 s.")]
        size = F.lit(f"Vehicles are {length:.1f} m long and {width:.1f} m wide; gaps are bumper to bumper.")
        pool = F.lit("Strategies: " + ", ".join(RELAX if phase == 2 else MERGE) + ".")
        return F.concat_ws("\n", *head, size, *own, *([before] if phase == 0 else []), *(after if phase == 2 else merge), F.lit(answer_form(phase)), pool)

    made = F.when(F.col("ego").isNotNull(), F.when(F.col("status") == 0, request(0)).when(F.col("status") == 1, request(1)).when(F.col("status") == 2, request(2)))
    return d.withColumn(out, made).select(*[c for c in rows.columns if c.lower() != out.lower()], out)


def inference_records(observed: DataFrame, split: str, system: Column, user: Column, prompt: Column) -> DataFrame:
    """(sample_id, event_id, source_split, system_prompt, user_prompt, prompt_text) of the observed samples (sample_id, event_id, split, ...) of a split. Samples with
    columns of the future, and texts made of such, are refused before anything runs."""
    rows = only_split(assert_no_future(observed), split)
    made = rows.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("event_id").cast("string").alias("event_id"), F.lit(split.strip().lower()).alias("source_split"), system.alias("system_prompt"), user.alias("user_prompt"), prompt.alias("prompt_text"))
    return assert_no_future(made)


def supervised_records(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Inference records of the train split with answer, intention and future_local of labels (sample_id, ...). Another split is an error, and so is a record without a label, or
    with one that lacks an answer, an intention or a future; each fails the query that meets it. Labels must be unique."""
    from ..operators.joins import checked, assert_unique

    keep = ("answer", "intention", "future_local")
    assert_unique(labels, "sample_id")
    joined = checked(records, labels.select("sample_id", *keep), "sample_id")
    lacks = F.when(F.col("source_split") != "train", "supervised records are of the train split").when(F.coalesce(F.trim("answer") == "", F.lit(True)), "no answer").when(F.col("intention").isNull(), "no intention")
    lacks = lacks.when(F.coalesce(F.size("future_local") < 1, F.lit(True)), "no future")
    fail = F.raise_error(F.concat(lacks, F.lit(": "), F.col("sample_id"))).cast("boolean")
    return joined.where(F.when(lacks.isNotNull(), fail).otherwise(True)).select(*records.columns, *keep)
