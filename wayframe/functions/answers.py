"""Strict readers of context and answer texts as column expressions, their vector codes, and token sequences for training."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .text import label, let, ranked_code, stripped

#: Labels of context answers in the order of their vector, and the keys of such an answer.
ACTIONS = ("STATIONARY", "STRAIGHT", "STRAIGHT_LEFT", "STRAIGHT_RIGHT", "LEFT_TURN", "RIGHT_TURN", "LEFT_U_TURN", "RIGHT_U_TURN")
AFFORDANCES = ("SLOW_ALLOW", "ACCELERATE_ALLOW", "LEFT_ALLOW", "RIGHT_ALLOW")
SCENARIOS = ("INTERSECTION", "ON_STRAIGHT_ROAD", "PARKING_LOT", "ON_ROADSIDE", "UNSURE")
KEYS = ("Situation Understanding", "Reasoning", "Actions", "Affordance", "Scenario_name")
#: Names of the classes of intention, by number.
INTENTIONS = ("Keep lane", "Left lane change", "Right lane change")
#: Decision fields that a strategy vector takes as numbers.
NUMBERS = ("aggressiveness", "risk_tolerance", "lateral_intent", "longitudinal_intent", "confidence", "stability_level")

#: Gaps that a decision may name, with their numbers, and the strategies that stand for none.
GAPS = {"GAP1": 0, "GAP2": 1, "EITHER": 2}
NO_MERGE, NO_SETTLING = "MAINTAIN_AND_OBSERVE", "MAINTAIN_STABLE"


def unfenced(text: Column) -> Column:
    """The text without blanks and without one code fence of whole lines around it; null where a fence is opened only."""
    t = stripped(text)
    inside = F.regexp_extract(t, r"(?is)^```(?:json)?[^\S\n]*\n(.*)\n[^\S\n]*```$", 1)
    return F.when(t.startswith("```"), F.nullif(stripped(inside), F.lit(""))).otherwise(t)


def same_keys(text: Column, allowed: tuple[str, ...]) -> Column:
    keys, want = F.json_object_keys(text), F.array(*map(F.lit, allowed))
    return F.coalesce((F.size(keys) == len(allowed)) & (F.size(F.array_except(want, keys)) == 0), F.lit(False))


def outer_json(text: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def field(v: Column, *path: str, kind: str = "variant") -> Column:
    """A field of a variant by its keys; null where it is absent or of another kind."""
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in path), kind)


def context(text: Column) -> Column:
    """Struct of situation, reasoning, actions, affordances and scenario, or null for an answer that breaks a rule.

    Exactly the five keys, each once; one to three actions, up to four affordances, no repeats after normalising, known labels, two
    texts that are not blank.
    """
    each = lambda a, names: F.transform(a, lambda x: label(x, names))
    known = lambda a, low, high: F.size(a).between(low, high) & F.forall(a, lambda x: x.isNotNull()) & (F.size(F.array_distinct(a)) == F.size(a))

    def read(body: Column) -> Column:
        form = same_keys(body, KEYS) & body.rlike(r"(?s)^\{.*\}$")
        return F.when(form, let(F.try_parse_json(body), names))

    def names(v: Column) -> Column:
        whole = lambda k: F.when(F.schema_of_variant(field(v, k)) == "STRING", F.nullif(stripped(field(v, k, kind="string")), F.lit("")))
        return let(
            F.struct(
                whole(KEYS[0]).alias("situation"), whole(KEYS[1]).alias("reasoning"), each(field(v, KEYS[2], kind="array<string>"), ACTIONS).alias("actions"),
                each(field(v, KEYS[3], kind="array<string>"), AFFORDANCES).alias("affordances"), label(field(v, KEYS[4], kind="string"), SCENARIOS).alias("scenario"),
            ),
            check,
        )

    def check(c: Column) -> Column:
        texts = c["situation"].isNotNull() & c["reasoning"].isNotNull() & c["scenario"].isNotNull()
        return F.when(texts & known(c["actions"], 1, 3) & known(c["affordances"], 0, 4), c)

    return let(unfenced(text), read)


def context_vector(c: Column) -> Column:
    """Seventeen numbers: ranks of the actions, which affordances there are, and the scenario."""

    def code(c: Column) -> Column:
        multi = F.array(*[F.when(F.array_contains(c["affordances"], a), 1.0).otherwise(0.0) for a in AFFORDANCES])
        one = F.array(*[F.when(c["scenario"] == s, 1.0).otherwise(0.0) for s in SCENARIOS])
        return F.when(c.isNotNull(), F.concat(ranked_code(c["actions"], ACTIONS), multi, one))

    return let(c, code)


def json_text(v: object) -> str | None:
    """A JSON value as text: strings as they are, null for null."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return repr(v).lower()
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


FIRST_NUMBER = re.compile(X.NUMBER, re.A)


def json_number(v: object, default: float = 0.0) -> float:
    """A JSON value as a number: of a boolean 1 or 0, else the first number in its text; the default for none and for what is not finite."""
    if isinstance(v, (bool, int, float)):
        try:
            x = float(v)
        except OverflowError:
            return default
    else:
        found = FIRST_NUMBER.search(json_text(v) or "")
        x = float(found[0]) if found else default
    return x if math.isfinite(x) else default


TEXT_PARTS = ("phase", "speed", "primary", "gap", "interaction")
PARTS = T.StructType([
    *[T.StructField(c, T.BooleanType()) for c in ("found", "good")], *[T.StructField(c, T.StringType()) for c in TEXT_PARTS],
    T.StructField("numbers", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("keys", "texts")], T.StructField("scores", T.ArrayType(T.DoubleType())),
])


def strategy_parts(text: str | None) -> tuple:
    """PARTS of an answer: what its first balanced object says, not yet normalised. Of keys that repeat the last counts."""
    body, v = X.first_object(text)
    if not isinstance(v, dict):
        return (body is not None, False, *(None,) * 9)
    part = lambda d, k: x if isinstance(x := d.get(k), dict) else {}
    decision, guidance = part(v, "decision"), part(v, "prediction_guidance")
    scores, texts = part(decision, "strategy_scores"), [json_text(d.get(k)) for d, k in ((v, "phase"), (guidance, "expected_speed_change"), (decision, "primary_strategy"), (decision, "target_gap"), (guidance, "key_interaction"))]
    numbers = [None if decision.get(k) is None else json_number(decision[k]) for k in NUMBERS]
    return True, True, *texts, numbers, list(scores), [json_text(x) for x in scores.values()], [min(max(json_number(x), 0.0), 1.0) for x in scores.values()]


@F.pandas_udf(PARTS)
def read_strategy(texts: pd.Series) -> pd.DataFrame:
    """Balanced braces are beyond regular expressions, so whole batches are read in Python, each text once."""
    return pd.DataFrame([strategy_parts(t) for t in texts], columns=PARTS.names)


def strategy_answer(text: Column, fallback: Column | str = X.PHASES[0]) -> Column:
    """Struct of vector (30 floats), mask, phase, status, primary_strategy, target_gap, speed_change, key_interaction, ignored and error.

    The vector is the phase (3), scores by strategy from 0 to 1 (12), the change of speed (3), six numbers and which of them there
    are (6 and 6). It reads the first balanced object of the text; where that is absent or no JSON, error says so and the rest is
    null. ignored: score keys that name no strategy, with their values. Of keys that repeat, and of keys of one strategy, the last counts.
    A target_gap that is absent or null is NONE.
    """

    def parts(p: Column) -> Column:
        """The scores last first, by strategy, and the texts as labels."""
        given = F.reverse(F.arrays_zip(F.transform(p["keys"], X.strategy).alias("s"), p["keys"].alias("k"), p["texts"].alias("v"), p["scores"].alias("x")))
        return F.struct(
            p["found"].alias("found"), p["good"].alias("good"), X.phase(p["phase"], fallback).alias("phase"), X.speed_change(p["speed"]).alias("speed"), p["numbers"].alias("numbers"),
            given.alias("given"), X.strategy(p["primary"]).alias("primary"), F.coalesce(p["gap"], F.lit("NONE")).alias("gap"), X.interaction(p["interaction"]).alias("interaction"),
        )

    def full(p: Column) -> Column:
        at = lambda names: F.transform(F.array(*map(F.lit, X.STRATEGIES)), lambda s: F.array_position(names, s))
        held = lambda v: F.transform(let(v["s"], at), lambda i: F.coalesce(F.get(v["x"], (i - 1).cast("int")), F.lit(0.0)))
        score = let(F.struct(p["given"]["s"].alias("s"), p["given"]["x"].alias("x")), held)
        mask = F.transform(p["numbers"], lambda x: F.when(x.isNull(), 0.0).otherwise(1.0))
        vector = F.concat(X.one_hot(p["phase"], X.PHASES), score, X.one_hot(p["speed"], X.SPEEDS), F.transform(p["numbers"], lambda x: F.coalesce(x, F.lit(0.0))), mask)
        left = F.filter(F.reverse(p["given"]), lambda g: ~g["s"].isin(*X.STRATEGIES))
        found = {
            "vector": vector.cast("array<float>"), "mask": mask.cast("array<float>"), "phase": p["phase"], "status": F.array_position(F.array(*map(F.lit, X.PHASES)), p["phase"]).cast("int") - 1,
            "primary_strategy": p["primary"], "target_gap": p["gap"], "speed_change": p["speed"], "key_interaction": p["interaction"],
            "ignored": F.map_from_entries(F.transform(left, lambda g: F.struct(g["k"], g["v"]))),
        }
        error = F.when(~p["found"], "no complete object").when(~p["good"], "not json")
        return F.struct(*[F.when(p["good"], c).alias(k) for k, c in found.items()], error.alias("error"))

    return let(read_strategy(text), lambda p: let(parts(p), full))


def one_line(text: Column) -> Column:
    return F.filter(F.split(text, r"\r\n|[\n\r\x0B\x0C]"), lambda x: x.rlike(r"\S"))


FEATURE = r"(?i)^\s*-\s*Notable\s+features?\s*:\s*(\S.*?)\s*$"
BEHAVIOR = r"(?i)^\s*-\s*Potential\s+behaviors?\s*:\s*(\S.*?)\s*$"
INTENTION = r"(?i)^\s*-\s*Intention\s*:\s*[\"']?([012])(?:\s*:\s*([^\"']+?))?[\"']?\s*$"


def joint_answer(text: Column, n: int = 50) -> Column:
    """Struct of features, behaviors, intention and points (floats), or null where the form of a thought and a final answer is not kept.

    Each line of the thought is a notable feature or a potential behavior, at least one of each. The intention may carry its name,
    which then must be that of its number; intention and trajectory may stand in quotes. Points are n pairs of finite numbers.
    """
    block = r"(?is)\A\s*Thought:\s*(.*?)\s*Final\s+answer:\s*(.*?)\s*\z"

    def read(parts: Column) -> Column:
        thought, final = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        of = lambda form: F.filter(F.transform(thought, lambda x: F.regexp_extract(x, form, 1)), lambda x: x != "")
        first = F.get(final, F.lit(0))
        number, name = F.regexp_extract(first, INTENTION, 1), F.lower(F.regexp_replace(stripped(F.regexp_extract(first, INTENTION, 2)), r"\s+", " "))
        wanted = F.get(F.transform(F.array(*map(F.lit, INTENTIONS)), lambda x: F.lower(x)), F.nullif(number, F.lit("")).try_cast("int"))
        rest = F.array_join(F.slice(final, 2, F.greatest(F.size(final) - 1, F.lit(0))), "\n")
        path = F.regexp_extract(rest, rf"(?is)^\s*-\s*Trajectory\s*:\s*+([\"'])\s*+({X.json_pairs(n)})\s*+\1\s*$", 2)
        bare = F.regexp_extract(rest, rf"(?is)^\s*-\s*Trajectory\s*:\s*+({X.json_pairs(n)})\s*$", 1)
        points = X.finite_pairs(F.coalesce(F.nullif(path, F.lit("")), F.nullif(bare, F.lit("")))).cast("array<array<float>>")
        return let(F.struct(of(FEATURE).alias("features"), of(BEHAVIOR).alias("behaviors"), number.try_cast("int").alias("intention"), points.alias("points")), lambda r: check(r, thought, number, name, wanted))

    def check(r: Column, thought: Column, number: Column, name: Column, wanted: Column) -> Column:
        said = (F.size(r["features"]) > 0) & (F.size(r["behaviors"]) > 0) & (F.size(r["features"]) + F.size(r["behaviors"]) == F.size(thought))
        small = F.forall(F.flatten(r["points"]), lambda x: F.abs(x) < float("inf"))
        return F.when(F.coalesce(said & (number != "") & ((name == "") | (name == wanted)) & small, F.lit(False)), r)

    part = lambda k: one_line(F.regexp_extract(text, block, k))
    return let(F.when(text.isNotNull(), F.array(part(1), part(2))), read)


def formatted_pairs(points: Column, precision: int = 2) -> Column:
    """Points (x, y) as JSON of rounded numbers without blanks."""
    one = lambda v: F.regexp_replace(F.format_string(f"%.{precision}f", v.cast("double")), r"(\.\d+?)0+$", "$1")
    return F.concat(F.lit("["), F.array_join(F.transform(points, lambda p: F.concat(F.lit("["), one(F.get(p, F.lit(0))), F.lit(","), one(F.get(p, F.lit(1))), F.lit("]"))), ","), F.lit("]"))


def formatted_joint(features: Column, behaviors: Column, intention: Column, points: Column, precision: int = 2) -> Column:
    """The answer text that joint_answer reads; null where a feature or behavior is blank or absent, or the intention is none."""
    lines = lambda head, a: F.transform(a, lambda x: F.concat(F.lit(f"- {head}: "), stripped(x)))
    good = F.coalesce((F.size(features) > 0) & (F.size(behaviors) > 0) & F.forall(F.concat(features, behaviors), lambda x: F.coalesce(stripped(x) != "", F.lit(False))) & intention.between(0, 2), F.lit(False))
    name = F.get(F.array(*map(F.lit, INTENTIONS)), intention)
    final = F.array(F.lit("Final answer:"), F.concat(F.lit('- Intention: "'), intention.cast("string"), F.lit(": "), name, F.lit('"')), F.concat(F.lit('- Trajectory: "'), formatted_pairs(points, precision), F.lit('"')))
    return F.when(good, F.array_join(F.concat(F.array(F.lit("Thought:")), lines("Notable feature", features), lines("Potential behavior", behaviors), final), "\n"))


def formatted_direct(points: Column, precision: int = 2) -> Column:
    return F.concat(F.lit('{"future_trajectory":'), formatted_pairs(points, precision), F.lit("}"))


#: Canonical classes of intention, and the spellings of each.
CLASSES = ("keep_lane", "left_lane_change", "right_lane_change")
SPELLINGS = {
    "0": "keep_lane",
    "keep": "keep_lane",
    "keep lane": "keep_lane",
    "lane keeping": "keep_lane",
    "lk": "keep_lane",
    "1": "left_lane_change",
    "left": "left_lane_change",
    "left lane change": "left_lane_change",
    "change left": "left_lane_change",
    "llc": "left_lane_change",
    "2": "right_lane_change",
    "right": "right_lane_change",
    "right lane change": "right_lane_change",
    "change right": "right_lane_change",
    "rlc": "right_lane_change",
}


def intention(value: Column) -> Column:
    """Canonical class of an intention by number or spelling, whatever its case, hyphens and underscores; null for others."""
    t = F.lower(stripped(F.regexp_replace(value.cast("string"), r"[-_\s]+", " ")))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv]), t)


def training_pair(prompt: Column, answer: Column, end: int, longest: int, ignored: int = -100) -> Column:
    """Struct of input_ids and labels: the prompt cut in its middle so that the answer and an end token always fit whole."""
    room = F.greatest(F.lit(longest - 1) - F.size(answer), F.lit(0))
    head = F.ceil(room / 2).cast("int")
    cut = F.when(F.size(prompt) <= room, prompt).otherwise(F.concat(F.slice(prompt, 1, head), F.slice(prompt, F.size(prompt) - (room - head) + 1, room - head)))
    tail = F.concat(answer, F.array(F.lit(end)))
    return F.struct(F.concat(cut, tail).alias("input_ids"), F.concat(F.array_repeat(F.lit(ignored), F.size(cut)), tail).alias("labels"))


def decision_labels(text: Column) -> Column:
    """Struct of the labels that a decision's JSON gives to a model, with defaults where a field is absent, null or of another kind.

    In RELAXATION strategies are numbered among those of settling and there is no gap (-1, N/A); else among those of merging. Strategies and
    gaps that are unknown have the number of the default. Null for a text that is no JSON object.
    """

    def make(v: Column) -> Column:
        word = lambda *path: field(v, *path, kind="string")
        number = lambda section, key, default: F.coalesce(field(v, section, key, kind="double"), F.lit(default))
        phase = F.upper(F.coalesce(word("phase"), F.lit("ANTICIPATION")))
        settled = phase == "RELAXATION"
        name = F.upper(F.coalesce(word("decision", "primary_strategy"), F.when(settled, NO_SETTLING).otherwise(NO_MERGE)))
        gap = F.when(settled, "N/A").otherwise(F.coalesce(word("decision", "target_gap"), F.lit("EITHER")))

        def place(names: tuple[str, ...], default: str) -> Column:
            return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), name), F.lit(0)) - 1, F.lit(names.index(default)))

        gap_id = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GAPS.items() for x in kv]), F.upper(gap)), F.lit(GAPS["EITHER"]))
        merging = lambda c: F.when(~settled, c)
        out = F.struct(
            phase.alias("phase"), name.alias("strategy"), F.when(settled, place(X.STRATEGIES[6:], NO_SETTLING)).otherwise(place(X.STRATEGIES[:6], NO_MERGE)).cast("int").alias("strategy_id"),
            gap.alias("gap"), F.when(settled, -1).otherwise(gap_id).alias("gap_id"), X.speed_change(word("prediction_guidance", "expected_speed_change")).alias("speed_change"),
            number("decision", "lateral_intent", 0.0).alias("lateral_intent"), number("decision", "longitudinal_intent", 0.0).alias("longitudinal_intent"), number("decision", "confidence", 0.5).alias("confidence"),
            F.coalesce(word("prediction_guidance", "expected_lateral_displacement_3s"), F.lit("0")).alias("lateral_displacement"), F.coalesce(word("prediction_guidance", "key_interaction"), F.lit("None")).alias("key_interaction"),
            F.when(settled, number("decision", "stability_level", 0.5)).alias("stability_level"), F.when(settled, F.coalesce(word("prediction_guidance", "target_speed"), F.lit("N/A"))).alias("target_speed"),
            F.when(settled, F.coalesce(word("prediction_guidance", "time_to_full_stability"), F.lit("3s"))).alias("time_to_stability"),
            merging(number("decision", "aggressiveness", 0.5)).alias("aggressiveness"), merging(number("decision", "risk_tolerance", 0.5)).alias("risk_tolerance"),
            merging(number("prediction_guidance", "gap_switch_probability", 0.0)).alias("gap_switch"), merging(number("prediction_guidance", "lane_change_completion_probability", 0.5)).alias("completion"),
        )
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), out)

    return let(F.try_parse_json(text), make)
