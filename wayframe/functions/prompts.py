"""Texts of a scene for a language model: exact number texts, a description of a window, chat envelopes and the reminder of a format."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import frames as R
from ..operators import samples as S
from .text import let
from .kinematics import KMH, finite, heading, rotated
from .text import stripped

#: Names of the neighbours in the order of samples.ROLES.
NAMES = ("leader beside", "follower beside", "second follower beside", "leader in lane", "follower in lane", "second follower in lane")


def exact_texts(numbers: Column, precision: int = 2) -> Column:
    """Texts of an array of numbers with fixed decimals, ties by the exact binary value, half to even; null for null and NaN, 0 for a negative zero.

    JVM formatters round the shortest decimal text of a double instead, which differs on ties, so this one step is Python, a batch at a time.
    """

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        form = lambda x: None if x is None or x != x else f"{x + 0.0:.{precision}f}"
        return batch.map(lambda a: None if a is None else [form(x) for x in a])

    return run(numbers.cast("array<double>"))


def road_text(lane: Column, lanes: int | None = None, places: dict[int, str] | None = None) -> Column:
    """The sentence on the road: its lanes where their number is known, the place of a lane only where places names it."""
    road = "a highway of several lanes" if lanes is None else f"a highway of {lanes} lanes"
    number = F.concat(F.lit(f"The target is on {road}, in the lane numbered "), lane.cast("string"), F.lit("; on which side that lane lies is not known."))
    out = number
    for k, place in (places or {}).items() if lanes is not None else ():
        out = F.when(lane == k, F.lit(f"The target is on {road}, in the {place} lane.")).otherwise(out)
    return out


def with_scene(samples: DataFrame, out: str = "scene", stride: int = 3, reach: float = 200.0, precision: int = 2, lanes: int | None = None, places: dict[int, str] | None = None) -> DataFrame:
    """Adapted samples (samples.adapted) with a description in lines: road, target, its path, and each role of samples.ROLES.

    Places and speeds are in the target's frame. Of a neighbour its last valid frame counts; one beyond reach is not told. A sample without
    history gives null.
    """
    base = 4 * len(S.ROLES)

    def numbers(now: Column) -> Column:
        yaw = F.coalesce(F.when(finite(now["yaw"]), heading(now["yaw"])), F.lit(0.0))
        speed = lambda r: [x * KMH for x in rotated(r["lon_v"], r["lat_v"], yaw)]
        away = lambda r: rotated(r["x"] - now["x"], r["y"] - now["y"], yaw)
        path = F.flatten(F.transform(R.strided(F.col("history"), stride), lambda p: F.array(*away(p))))
        of = lambda r: F.when(r.isNotNull(), F.array(*away(r), *speed(r)))
        others = F.transform("neighbors", lambda a: F.coalesce(let(S.last_valid(a), of), F.array(*[F.lit(None).cast("double")] * 4)))
        return F.concat(F.flatten(others), F.array(*speed(now), now["acc"]), path)

    n, t = (lambda j: F.get("_scene_numbers", F.lit(j))), (lambda j: F.get("_scene_texts", F.lit(j)))
    # one array of all numbers, so that a row goes to Python once; sides are words, so their numbers lose the sign
    unsigned = F.transform("_scene_numbers", lambda x, i: F.when((i < base) & (i % 4 < 2), F.abs(x)).otherwise(x))

    def line(k: int) -> Column:
        x, y = n(4 * k), n(4 * k + 1)
        said = F.concat(t(4 * k), F.when(x >= 0, " m ahead, ").otherwise(" m behind, "), t(4 * k + 1), F.when(y >= 0, " m left, ").otherwise(" m right, "), F.lit("moving ("), t(4 * k + 2), F.lit(", "), t(4 * k + 3), F.lit(") km/h"))
        told = F.when(x.isNull(), "not seen").when(F.sqrt(x * x + y * y) > reach, f"none within {reach:g} m").otherwise(said)
        return F.concat(F.lit(f"{NAMES[k]}: "), told)

    places_of = F.slice("_scene_texts", base + 4, F.greatest(F.size("_scene_texts") - base - 3, F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(places_of) / 2).cast("int") - 1), lambda i: F.concat(F.lit("("), F.get(places_of, 2 * i), F.lit(", "), F.get(places_of, 2 * i + 1), F.lit(")")))
    target = F.concat(F.lit("target: moving ("), t(base), F.lit(", "), t(base + 1), F.lit(") km/h, acceleration "), t(base + 2), F.lit(" m/s^2"))
    lane = F.rint(F.try_element_at("ego", F.lit(-1))["lane_id"]).cast("long")
    lines = [road_text(lane, lanes, places), target, F.concat(F.lit("path: "), F.array_join(pairs, " ")), *[line(k) for k in range(len(S.ROLES))]]
    made = samples.withColumn("_scene_numbers", let(F.try_element_at("history", F.lit(-1)), numbers)).withColumn("_scene_texts", exact_texts(unsigned, precision))
    return made.withColumn(out, F.when(F.size("history") > 0, F.concat_ws("\n", *lines))).drop("_scene_numbers", "_scene_texts")


def task_text(n: int = 50, hz: float = 10.0) -> str:
    """The instructions that go before a scene: frame, and the answer that answers.joint_answer reads."""
    if n <= 0 or hz <= 0:
        raise ValueError("points and rate must be positive")
    return "\n".join([
        f"Foresee what the target vehicle will do and where it will be over the next {n / hz:g} s.",
        "Lengths are in metres, with the target at (0, 0), x along its heading and y to its left.",
        "Answer in these lines and no others:",
        "Thought:", "- Notable features: <what you see>", "- Potential behaviors: <what may follow>",
        "Final answer:", '- Intention: "<0, 1 or 2>: <Keep lane, Left lane change or Right lane change>"', f'- Trajectory: "[[x1, y1], ..., [x{n}, y{n}]]", one point every {1 / hz:g} s',
    ])


def reminder_text(n: int = 50) -> str:
    """What a second request adds after an answer in another format than text.strict_points reads."""
    if n <= 0:
        raise ValueError("points must be positive")
    return f'That answer cannot be read. Send one JSON object and nothing else, with the single key "future_trajectory" and as its value {n} pairs [x, y] of finite numbers.'


def chat(system: Column, user: Column) -> Column:
    """Struct of error and prompt_text, the envelope of one turn; an error and no text where either part is null or blank."""
    s, u = stripped(system), stripped(user)
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    error = F.when(blank(s), "no system text").when(blank(u), "no user text")
    text = F.concat(F.lit("<s>[INST] <<SYS>>\n"), s, F.lit("\n<</SYS>>\n\n"), u, F.lit(" [/INST]"))
    return F.struct(error.alias("error"), F.when(error.isNull(), text).alias("prompt_text"))
