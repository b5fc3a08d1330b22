"""Raw samples of positional rows to checked observations, and the feature arrays that models and retrieval take of them.

A raw sample has the columns of RAW: matrices are arrays of rows, rows are arrays of numbers. Everything is a column expression, so a
sample never leaves its row or the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.kinematics import KMH, finite, heading, rotated, turned
from ..functions.text import identifier
from .frames import aligned, present_loose, present_strict, tail_window

#: The place of each field in the rows of a matrix.
EGO = {"id": 0, "lane_id": 1, "frame": 2, "x": 3, "y": 4, "upper": 5, "lower": 6, "lat_v": 15, "lon_v": 16, "acc": 17, "yaw": 18}
NEIGHBOR = {"id": 0, "lane_id": 1, "x": 2, "y": 3, "lon_v": 4, "lat_v": 5, "acc": 6, "yaw": 7}
HISTORY = {"x": 0, "y": 1, "lon_v": 2, "lat_v": 3, "acc": 4, "yaw": 5}
#: The neighbours of a sample in their order.
ROLES = ("phys_tl", "phys_tf", "phys_tff", "phys_ol", "phys_of", "phys_off")

MATRIX = "array<array<double>>"
RAW = f"scenario_id double, traj_id double, lane_status double, time_since_crossing double, x_hist {MATRIX}, ctx struct<ego: {MATRIX}, {', '.join(f'{r}: {MATRIX}' for r in ROLES)}>, y_future {MATRIX}"


def named(matrix: Column, columns: dict[str, int]) -> Column:
    """Rows as structs. A field is null where its place is negative or the row too short."""
    at = lambda r, i: F.get(r, F.lit(i)) if i >= 0 else F.lit(None).cast("double")
    return F.transform(matrix, lambda r: F.struct(*[at(r, i).alias(k) for k, i in columns.items()]))


def finite_or_zero(v: Column) -> Column:
    return F.when(finite(v), v).otherwise(0.0)


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with the columns, each computed once a row: Spark writes a projection into every filter and column that reads it, but no generator."""
    made = rows.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
    return made.withColumns({k: F.col("_once")[k] for k in columns}).drop("_once")


def zeroed(frames: Column, fields=tuple(NEIGHBOR)) -> Column:
    """Frames with `valid`: a positive id and a finite place. All fields of other frames are 0, and so are fields that are not finite."""

    def row(r: Column) -> Column:
        ok = finite(r["id"]) & (r["id"] > 0) & finite(r["x"]) & finite(r["y"])
        known = F.struct(*[(r[k] if k in ("id", "x", "y") else finite_or_zero(r[k])).alias(k) for k in fields], F.lit(True).alias("valid"))
        return F.when(ok, known).otherwise(F.struct(*[F.lit(0.0).alias(k) for k in fields], F.lit(False).alias("valid")))

    return F.transform(frames, row)


def without_gaps(frames: Column) -> Column:
    """Frames whose x is not NaN, or null where fewer than two are left."""
    kept = F.filter(frames, lambda r: F.coalesce(~F.isnan(r["x"]), F.lit(False)))
    return F.when(F.size(kept) >= 2, kept)


def last_valid(frames: Column) -> Column:
    """The last frame that is valid, or null."""
    return F.try_element_at(F.filter(frames, lambda r: r["valid"]), F.lit(-1))


def adapted(raw: DataFrame, steps: int = 10, statuses: tuple[int, ...] | None = None, future_rows: int | None = None, atol: float = 1e-3) -> DataFrame:
    """raw (RAW) with sample_id, event_id, status, history, ego, neighbors, future and error; other columns stay.

    The last `steps` rows are the history. history, ego: arrays of structs; neighbors: per role of ROLES an array of `steps` frames
    with `valid`, early ones invalid where there are fewer, all of them where the role is absent. future: points (x, y), null
    where there is none. error: the first rule that a sample breaks, else null; then the other new columns but the ids may hold anything.
    statuses: the lane_status that are allowed (any integer by default); future_rows: rows that the future must have.
    """
    none = F.array().cast(MATRIX)
    tail = lambda c, columns: named(F.slice(c, -steps, steps), columns)
    lacks = lambda c, n: F.coalesce(F.exists(c, lambda r: F.coalesce(F.size(r), F.lit(0)) < n), F.lit(False))
    few = lambda c: F.coalesce(F.size(c), F.lit(0)) < steps
    tails = lambda c, columns: F.when(~few(c), tail(c, columns))
    roles = [zeroed(named(tail_window(F.coalesce(F.col(f"ctx.{r}"), none), steps), NEIGHBOR)) for r in ROLES]
    # the rules read these often; the neighbours are made of good samples only, for no rule reads them
    made = once(raw, {
        "history": tails(F.col("x_hist"), HISTORY),
        "_ego": tails(F.col("ctx.ego"), EGO),
        "future": F.transform("y_future", lambda r: F.struct(F.get(r, F.lit(0)).alias("x"), F.get(r, F.lit(1)).alias("y"))),
    })
    number = lambda c: finite(F.col(c))
    place = lambda r: finite(r["x"]) & finite(r["y"])
    every = lambda r: F.forall(F.array(*[r[k] for k in HISTORY]), finite)
    status = F.col("lane_status")
    allowed = F.lit(True) if statuses is None else status.isin(*statuses)
    rules = [
        (few(F.col("x_hist")), "x_hist has too few rows"),
        (lacks(F.col("x_hist"), len(HISTORY)), "x_hist has too few columns"),
        (~F.forall("history", every), "x_hist is not finite"),
        (few(F.col("ctx.ego")), "ego has too few rows"),
        (lacks(F.col("ctx.ego"), max(EGO.values()) + 1), "ego has too few columns"),
        (~F.forall("_ego", place), "ego has no place"),
        (~aligned(F.col("history"), F.col("_ego"), atol), "x_hist and ego are not aligned"),
        *[(lacks(F.col(f"ctx.{r}"), len(NEIGHBOR)), f"{r} has too few columns") for r in ROLES],
        (~number("scenario_id") | ~number("traj_id"), "an identifier is missing"),
        (~number("lane_status") | (status != F.rint(status)) | ~allowed, "lane_status is not allowed"),
        (~number("time_since_crossing"), "time_since_crossing is not finite"),
        (F.exists("future", lambda p: ~place(p)), "y_future is not finite"),
    ]
    if future_rows is not None:
        rules.append((F.size("future") != future_rows, "y_future has another number of rows"))
    error = F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), text) for broken, text in rules])
    # half to even, as the key of a frame is defined
    frame = F.rint(F.try_element_at("_ego", F.lit(-1))["frame"]).cast("long").cast("string")
    key = F.concat_ws(":", identifier(F.col("scenario_id")), identifier(F.col("traj_id")), F.coalesce(frame, F.lit("")))
    ego = F.transform("_ego", lambda r: F.struct(*[finite_or_zero(r[k]).alias(k) for k in EGO]))
    new = {"neighbors": F.array(*roles), "sample_id": key, "event_id": identifier(F.col("scenario_id")), "status": status.try_cast("int"), "ego": ego, "error": error}
    return made.withColumns(new).drop("_ego")


def unwrapped(v: Column, kind: str, layers: int = 3) -> Column:
    """The value of a variant as kind, a number, text or object, or arrays of these, through up to `layers` arrays of one element around it.

    Null where there is none, and for arrays without elements; what inside of arrays is of another kind is null.
    """
    get = lambda path, k="variant": F.try_variant_get(v, "$" + path, k)
    rank, out = kind.count("array<"), []
    for d in range(layers + 1):
        single = [get("[0]" * i + "[1]").isNull() for i in range(d)]
        fits = get("[0]" * (d + rank)).isNotNull() & get("[0]" * (d + rank + 1)).isNull()
        for test in single:
            fits = fits & test
        out.append(F.when(fits, get("[0]" * d, kind)))
    return F.coalesce(*out)


def lenient(text: Column) -> Column:
    """Struct of status, ego and neighbors of a sample in JSON; what cannot be read is 0, null and absent, and nothing is an error.

    neighbors maps roles to their rows. Arrays of one element around a number, a matrix or ctx are looked through. Null for no JSON at all.
    """

    def build(v: Column) -> Column:
        status = F.coalesce(unwrapped(F.try_variant_get(v, "$.lane_status", "variant"), "double").try_cast("int"), F.lit(0))
        ctx = F.coalesce(unwrapped(F.try_variant_get(v, "$.ctx", "variant"), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        matrices = lambda c: F.map_filter(F.transform_values(c, lambda k, m: unwrapped(m, MATRIX)), lambda k, m: m.isNotNull())
        return let(ctx, lambda c: let(matrices(F.map_filter(c, lambda k, m: k.isin("ego", *ROLES))), lambda ms: F.struct(status.alias("status"), F.try_element_at(ms, F.lit("ego")).alias("ego"), F.map_filter(ms, lambda k, m: k != "ego").alias("neighbors"))))

    return let(F.try_parse_json(text), lambda v: F.when(v.isNotNull(), build(v)))


def split_by_error(samples: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and the others with it."""
    return samples.where(F.col(error).isNull()).drop(error), samples.where(F.col(error).isNotNull())


def by_phase(status: Column, neighbors: Column) -> Column:
    """The three neighbours that count: those of the old lane in status 2, else those of the target lane."""
    return F.when(status == 2, F.slice(neighbors, 4, 3)).otherwise(F.slice(neighbors, 1, 3))


def history_vector(ego: Column, neighbors: Column, strict: bool = True) -> Column:
    """Flat [steps, 1 + neighbours, 4]: ego's place from its first one and its speeds; neighbours' places from the ego's, and their speeds.

    neighbors: array of arrays of frames (x, y, lon_v, lat_v). Those that are shorter than the ego's history go on at the origin without speed.
    A neighbour that is not present has zeros. strict: any place that is not finite makes it absent; else it does so only where all places are at the origin.
    """
    steps = F.size(ego)
    still = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "lon_v", "lat_v")])

    def present(a: Column) -> Column:
        lean = F.transform(F.slice(a, 1, steps), lambda r: F.struct(*[r[k].alias(k) for k in ("x", "y", "lon_v", "lat_v")]))
        whole = F.concat(lean, F.array_repeat(still, F.greatest(steps - F.size(lean), F.lit(0))))
        return F.when(present_strict(whole) if strict else present_loose(whole), whole)

    def rows(others: Column) -> Column:
        first = F.get(ego, F.lit(0))

        def row(e: Column, i: Column) -> Column:
            mine = F.array(e["x"] - first["x"], e["y"] - first["y"], e["lon_v"], e["lat_v"])
            theirs = F.transform(others, lambda a: let(F.get(a, i), lambda r: F.when(r.isNull(), F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(r["x"] - e["x"], r["y"] - e["y"], r["lon_v"], r["lat_v"]))))
            return F.concat(mine, F.flatten(theirs))

        return F.flatten(F.transform(ego, row))

    return let(F.transform(neighbors, present), rows)


def target_vector(future: Column, ego: Column, n: int) -> Column:
    """Flat [n, 2]: the first n points of the future from the first place of the history; null where there are fewer."""
    o = F.get(ego, F.lit(0))
    return F.when(F.size(future) >= n, F.flatten(F.transform(F.slice(future, 1, n), lambda p: F.array(p["x"] - o["x"], p["y"] - o["y"]))))


def agent_tensor(history: Column, neighbors: Column) -> Column:
    """[agents, steps, 7] from the last frame of the history: place, speeds, acceleration, sine and cosine of the yaw; zeros where invalid."""

    def build(o: Column) -> Column:
        def features(r: Column) -> Column:
            yaw = r["yaw"] - o["yaw"]
            return F.array(*turned(r["x"] - o["x"], r["y"] - o["y"], o["c"], o["s"]), *turned(r["lon_v"], r["lat_v"], o["c"], o["s"]), r["acc"], F.sin(yaw), F.cos(yaw))

        others = F.transform(neighbors, lambda a: F.transform(a, lambda r: F.when(r["valid"], features(r)).otherwise(F.array(*[F.lit(0.0)] * 7))))
        return F.concat(F.array(F.transform(history, features)), others)

    origin = lambda o: F.struct(o["x"].alias("x"), o["y"].alias("y"), o["yaw"].alias("yaw"), F.cos(o["yaw"]).alias("c"), F.sin(o["yaw"]).alias("s"))
    return let(F.try_element_at(history, F.lit(-1)), lambda o: let(origin(o), build))


def agent_mask(history: Column, neighbors: Column) -> Column:
    """[agents, steps], 1 where a frame is valid."""
    ones = F.transform(history, lambda r: F.lit(1.0))
    return F.concat(F.array(ones), F.transform(neighbors, lambda a: F.transform(a, lambda r: F.when(r["valid"], 1.0).otherwise(0.0))))


def lane_boundaries(ego: Column, default: float = 3.9, sides: int = 1) -> Column:
    """Sideways places of the lane's own boundaries and of `sides` lanes on each side, sorted; a lane is as wide as the median plausible width."""

    def build(widths: Column, last: Column) -> Column:
        n = F.size(widths)
        at = lambda i: F.get(widths, i.cast("int"))
        width = F.coalesce((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, F.lit(default))
        own = lambda k, w: F.when(finite(last[k]) & (last[k] > 0), last[k]).otherwise(w / 2)
        return let(width, lambda w: F.array_sort(F.flatten(F.array(*[F.array(-own("upper", w) - i * w, own("lower", w) + i * w) for i in range(sides + 1)]))))

    plausible = F.filter(F.transform(ego, lambda r: r["upper"] + r["lower"]), lambda w: finite(w) & (w > 1.5) & (w < 8.0))
    return let(F.try_element_at(ego, F.lit(-1)), lambda last: let(F.sort_array(plausible), lambda widths: build(widths, last)))


def lane_lines(ego: Column, behind: float = 35.0, ahead: float = 55.0, n: int = 20, default: float = 3.9, sides: int = 1) -> Column:
    """[boundaries, n, 2]: points of each boundary at even places from behind to ahead."""
    places = F.array(*[F.lit(-behind + i * ((behind + ahead) / (n - 1))) for i in range(n)])
    return F.transform(lane_boundaries(ego, default, sides), lambda y: F.transform(places, lambda x: F.array(x, y)))


def retrieval_vector(history: Column, ego: Column, neighbors: Column, behind: float = 35.0, ahead: float = 55.0, n: int = 20) -> Column:
    """Agents, their mask, lane lines and the mask of these in one flat array: 490 + 70 + 160 + 80 numbers for ten steps."""

    def join(lines: Column, others: Column) -> Column:
        ones = F.array_repeat(F.lit(1.0), F.size(lines) * n)
        return F.concat(F.flatten(F.flatten(agent_tensor(history, others))), F.flatten(agent_mask(history, others)), F.flatten(F.flatten(lines)), ones)

    return let(lane_lines(ego, behind, ahead, n), lambda lines: let(neighbors, lambda others: join(lines, others)))


def local_future(future: Column, history: Column, n: int) -> Column:
    """n structs (fwd, left, valid) of the first points of the future; those that are not finite or not there are 0 and not valid."""
    o = F.try_element_at(history, F.lit(-1))

    def point(i: Column) -> Column:
        return let(F.get(future, i), lambda p: seen(p, F.coalesce(finite(p["x"]) & finite(p["y"]), F.lit(False))))

    def seen(p: Column, ok: Column) -> Column:
        fwd, left = rotated(p["x"] - o["x"], p["y"] - o["y"], o["yaw"])
        return F.struct(F.when(ok, fwd).otherwise(0.0).alias("fwd"), F.when(ok, left).otherwise(0.0).alias("left"), ok.alias("valid"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def map_points(frames: Column, origin: Column) -> Column:
    """Points as a map shows them: sideways, then forward, and not turned."""
    return F.transform(frames, lambda r: F.array(r["y"] - origin["y"], r["x"] - origin["x"]))


def notable(history: Column, neighbors: Column, most: int = 4) -> Column:
    """Structs (what, agent, value) of what is notable in a window, at most `most`, those of the target first; one `steady` where nothing is.

    Sideways speed above 1.5 km/h, acceleration beyond 0.5 m/s^2; of neighbours within 100 m, by role: ahead and over 2 km/h slower, or else
    within 40 m. Agents are 0 for the target and 1 on for the roles.
    """

    def build(o: Column) -> Column:
        yaw = F.coalesce(F.when(finite(o["yaw"]), heading(o["yaw"])), F.lit(0.0))
        speed, sideways = rotated(o["lon_v"], o["lat_v"], yaw)
        made = lambda what, agent, v: F.struct(F.lit(what).alias("what") if isinstance(what, str) else what.alias("what"), agent.alias("agent"), v.alias("value"))
        me = F.lit(0)
        own = F.array(
            F.when(F.abs(sideways * KMH) > 1.5, made(F.when(sideways > 0, "moves_left").otherwise("moves_right"), me, F.abs(sideways * KMH))),
            F.when(o["acc"] > 0.5, made("accelerates", me, o["acc"])).when(o["acc"] < -0.5, made("brakes", me, o["acc"])),
        )

        def one(a: Column, i: Column) -> Column:
            return let(last_valid(a), lambda r: told(r, i))

        def told(r: Column, i: Column) -> Column:
            away, slower = rotated(r["x"] - o["x"], r["y"] - o["y"], yaw)[0], (rotated(r["lon_v"], r["lat_v"], yaw)[0] - speed) * KMH
            near = F.when(F.abs(away) < 40.0, made(F.when(away >= 0, "ahead").otherwise("behind"), i + 1, F.abs(away)))
            return F.when(F.abs(away) <= 100.0, F.when((away >= 0) & (slower < -2.0), made("slower_ahead", i + 1, F.abs(slower))).otherwise(near))

        found = F.filter(F.concat(own, F.transform(neighbors, one)), lambda s: s.isNotNull())
        return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(F.array(made("steady", me, F.lit(0.0))))

    return let(F.try_element_at(history, F.lit(-1)), build)


#: Sentences for notable(); {} is the neighbour's letter or nothing, %.2f the value.
SENTENCES = {
    "moves_left": "target drifts left at %.2f km/h",
    "moves_right": "target drifts right at %.2f km/h",
    "accelerates": "target speeds up by %.2f m/s^2",
    "brakes": "target slows down by %.2f m/s^2",
    "slower_ahead": "vehicle {} leads and is slower by %.2f km/h",
    "ahead": "vehicle {} is %.2f m in front",
    "behind": "vehicle {} is %.2f m behind",
    "steady": "target moves steadily",
}
#: What may follow, by class of intention.
BEHAVIORS = ("stay in this lane and match the speed around", "move one lane to the left with safe gaps", "move one lane to the right with safe gaps")


def sentences(found: Column) -> Column:
    """notable() as texts, neighbours by the letters A to F in order of roles."""

    def text(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for what, form in SENTENCES.items():
            before, _, after = form.partition("{}")
            form_of = lambda t: F.format_string(t, s["value"]) if "%" in t else F.lit(t)
            said = form_of(form) if "{}" not in form else F.concat(F.lit(before), F.char(s["agent"].cast("long") + 64), form_of(after))
            out = F.when(s["what"] == what, said).otherwise(out)
        return out

    return F.transform(found, text)


def behaviors(intention: Column) -> Column:
    """The sentence of a class of intention in an array; null for another number."""
    said = F.get(F.array(*map(F.lit, BEHAVIORS)), intention)
    return F.when(said.isNotNull(), F.array(said))


def phase_intention(status: Column) -> Column:
    """Class of intention of events that all go to the left: 1 before and in the crossing, 0 after it; null for another status."""
    return F.when(status.isin(0, 1), 1).when(status == 2, 0)


def seeded_order(key: str, seed: int) -> Column:
    """A random key of a row that the seed and the row's own key fix."""
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256)


def sampled(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n random rows without repeats, all where there are fewer; the same for a seed however rows are partitioned."""
    return rows.orderBy(seeded_order(key, seed), key).limit(n)


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in a random order, by a sort over ranges."""
    return rows.orderBy(seeded_order(key, seed), key)
