"""Scenario documents: reading, validation, normalisation to long tables, centring, town edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = 91
SCHEMA_VERSION = 1

_XYZ = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
SCENARIO = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("scenario_id", T.StringType()),
        T.StructField(
            "objects",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()), T.StructField("type", T.StringType()),
                        T.StructField("position", T.ArrayType(_XYZ)), T.StructField("velocity", T.ArrayType(_XYZ)),
                        T.StructField("heading", T.ArrayType(T.DoubleType())), T.StructField("valid", T.ArrayType(T.BooleanType())),
                        T.StructField("width", T.DoubleType()), T.StructField("length", T.DoubleType()), T.StructField("height", T.DoubleType()),
                        T.StructField("goalPosition", _XYZ), T.StructField("mark_as_expert", T.BooleanType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "roads",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()), T.StructField("map_element_id", T.LongType()), T.StructField("type", T.StringType()),
                        T.StructField("geometry", T.ArrayType(_XYZ)),
                    ]
                )
            ),
        ),
        T.StructField("tl_states", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("sdc_track_index", T.LongType()),
                    T.StructField("tracks_to_predict", T.ArrayType(T.StructType([T.StructField("track_index", T.LongType())]))),
                ]
            ),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_scenarios(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """One row per JSON document with its file; ``recursive`` also reads group subdirectories."""
    reader = spark.read.schema(SCENARIO).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", recursive)
    return reader.option("pathGlobFilter", "*.json").json(path).withColumn("source_file", F.col("_metadata.file_path"))


def validity(doc: DataFrame) -> Column:
    """Structural rules: required keys, objects with position and type, roads with geometry that has x and y."""
    c = F.col
    ok = c("name").isNotNull() & c("objects").isNotNull() & c("roads").isNotNull() & c("tl_states").isNotNull()
    if "_corrupt_record" in doc.columns:
        ok = ok & c("_corrupt_record").isNull()
    objects = F.forall("objects", lambda o: o["position"].isNotNull() & o["type"].isNotNull())
    roads = F.forall("roads", lambda r: r["geometry"].isNotNull() & F.forall(r["geometry"], lambda g: g["x"].isNotNull() & g["y"].isNotNull()))
    return F.coalesce(ok & objects & roads, F.lit(False))


def validate_scenarios(doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): bad documents are set aside with their file, never deleted."""
    marked = doc.withColumn("_ok", validity(doc))
    return marked.filter("_ok").drop("_ok"), marked.filter("not _ok").drop("_ok")


def map_object_type(kind: Column) -> Column:
    """Vehicle 1, pedestrian 2, cyclist 3, anything else 0."""
    return F.when(kind == "vehicle", 1).when(kind == "pedestrian", 2).when(kind == "cyclist", 3).otherwise(0)


def map_road_type(code: Column, word: Column | None = None) -> Column:
    """Raw map codes to road types; the words win over the code, and code 4 passes through."""
    raw = code.cast("int")
    if word is not None:
        raw = F.when(word == "lane", 2).when(word == "road_edge", 15).otherwise(raw)
    # Raw ranges per road type.
    return (
        F.when(raw.between(0, 3), 4).when(raw.between(5, 13), 5).when(raw.between(14, 16), 6).when(raw == 17, 7)
        .when(raw == 18, 8).when(raw == 19, 9).when(raw == 20, 10).otherwise(raw)
    )


def agents(doc: DataFrame) -> DataFrame:
    """Agent dimension table, one row per object in document order."""
    o = doc.select("scenario_id", "metadata", F.posexplode("objects").alias("agent_idx", "o"))
    return o.select(
        "scenario_id", F.col("agent_idx").cast("long").alias("agent_idx"), F.col("o.id").alias("agent_id"), map_object_type(F.col("o.type")).alias("object_type"),
        F.coalesce("o.length", F.lit(0.0)).alias("length"), F.coalesce("o.width", F.lit(0.0)).alias("width"), F.coalesce("o.height", F.lit(0.0)).alias("height"),
        F.coalesce("o.goalPosition.x", F.lit(0.0)).alias("goal_x"), F.coalesce("o.goalPosition.y", F.lit(0.0)).alias("goal_y"), F.coalesce("o.goalPosition.z", F.lit(0.0)).alias("goal_z"),
        F.coalesce("o.mark_as_expert", F.lit(False)).alias("mark_as_expert"),
        F.coalesce(F.exists("metadata.tracks_to_predict", lambda t: t["track_index"] == F.col("agent_idx")), F.lit(False)).alias("is_track_to_predict"),
    )


def agent_states(doc: DataFrame, steps: int = STEPS) -> DataFrame:
    """Long table with exactly ``steps`` rows per object; what a document leaves out becomes 0 / invalid."""
    o = doc.select("scenario_id", F.posexplode("objects").alias("agent_idx", "o"))
    s = o.select("scenario_id", F.col("agent_idx").cast("long").alias("agent_idx"), "o", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))

    def at(path: str, field: str | None = None) -> Column:
        v = F.get(F.col(path), F.col("step"))
        return F.coalesce(v[field] if field else v, F.lit(0.0))

    return s.select(
        "scenario_id", "agent_idx", F.col("o.id").alias("agent_id"), F.col("step").cast("long").alias("step"),
        *[at("o.position", c).alias(c) for c in "xyz"], *[at("o.velocity", c).alias(f"v{c}") for c in "xyz"], at("o.heading").alias("heading"),
        F.coalesce(F.get(F.col("o.valid"), F.col("step")), F.lit(False)).alias("valid"),
    )


def normalize_tracks(state: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """Pads sparse long tracks to ``steps`` dense rows: missing numbers 0, missing ``valid`` false."""
    grid = state.select(*keys).distinct().withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    out = grid.join(state, [*keys, "step"], "left")
    numbers = [c for c, t in state.dtypes if c not in (*keys, "step") and t in ("double", "float", "int", "bigint")]
    return out.na.fill(0, numbers).withColumn("valid", F.coalesce("valid", F.lit(False)))


def roads(doc: DataFrame) -> DataFrame:
    r = doc.select("scenario_id", F.posexplode("roads").alias("road_idx", "r"))
    word = F.col("r.type")
    return r.select(
        "scenario_id", F.col("road_idx").cast("long").alias("road_idx"), F.col("r.id").alias("road_id"),
        map_road_type(F.coalesce("r.map_element_id", F.lit(0)), word).alias("road_type"), F.coalesce("r.map_element_id", F.lit(0)).alias("raw_type"), F.col("r.geometry").alias("pts"),
    )


def road_points(road: DataFrame, keys: list[str] = ["scenario_id", "road_idx"]) -> DataFrame:
    """Points of each road as rows (polyline_id, pt_idx), ready for ``to_segments``."""
    p = road.select(*keys, "road_type", F.posexplode("pts").alias("pt_idx", "p"))
    return p.select(*keys, "road_type", F.col("pt_idx").cast("long").alias("pt_idx"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def strip_objects(scenario: DataFrame, agent: DataFrame, road: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roads-only dataset: (scenario without references to objects, untouched roads, audit row)."""
    bare = scenario.withColumns({"sdc_track_index": F.lit(-1).cast("long"), "tracks_to_predict": F.array().cast("array<bigint>")})
    removed = agent.groupBy("scenario_id").agg(F.count("*").alias("objects_removed"), F.sum("bytes").alias("object_bytes"))
    kept = road.groupBy("scenario_id").agg(F.count("*").alias("roads_kept"), F.sum("bytes").alias("road_bytes"))
    audit = removed.join(kept, "scenario_id", "full_outer").na.fill(0)
    after = F.col("road_bytes")
    before = F.col("road_bytes") + F.col("object_bytes")
    return bare, road, audit.withColumns({"bytes_before": before, "bytes_after": after, "ratio": F.when(before > 0, after / before)})


def scenario_center(state: DataFrame, road_point: DataFrame, map_key: str = "scenario_id") -> DataFrame:
    """Mean of valid agent points and all road points per scenario.  Sums are taken on each side first, so
    points never meet points."""
    a = state.groupBy("scenario_id", *([map_key] if map_key != "scenario_id" else [])).agg(
        F.sum(F.when(F.col("valid"), F.col("x"))).alias("ax"), F.sum(F.when(F.col("valid"), F.col("y"))).alias("ay"), F.count_if("valid").alias("an")
    )
    b = road_point.groupBy(map_key).agg(F.sum("x").alias("bx"), F.sum("y").alias("by"), F.count("*").alias("bn"))
    j = a.join(b, map_key, "left").na.fill(0)
    n = F.col("an") + F.col("bn")
    return j.filter(n > 0).select("scenario_id", ((F.col("ax") + F.col("bx")) / n).alias("mx"), ((F.col("ay") + F.col("by")) / n).alias("my"))


def center_scenario(state: DataFrame, center: DataFrame, sign: int = -1) -> DataFrame:
    """Subtracts (sign -1) or adds back (sign +1) the scenario centre; invalid points stay as they are."""
    j = state.join(center, "scenario_id")
    move = {c: F.when(F.col("valid"), F.col(c) + F.col(f"m{c}") * sign).otherwise(F.col(c)) for c in "xy"}
    return j.withColumns(move).drop("mx", "my")


def replace_roads(scenario: DataFrame, town_roads: DataFrame) -> DataFrame:
    """Scenario roads replaced by the master roads of the town its name starts with (``town01_x`` -> ``town01``)."""
    town = F.lower(F.substring_index("name", "_", 1))
    masters = town_roads.withColumn("_town", F.lower("town")).drop("town")
    return scenario.withColumn("_town", town).join(masters, "_town").drop("_town")


def zero_initial_velocity(state: DataFrame) -> DataFrame:
    """Step-0 velocity of non-expert objects becomes zero."""
    still = (F.col("step") == 0) & ~F.col("mark_as_expert")
    return state.withColumns({c: F.when(still, 0.0).otherwise(F.col(c)) for c in ("vx", "vy") if c in state.columns})


def mark_experts(agent: DataFrame) -> DataFrame:
    """Every object but the first of its scenario is an expert."""
    first = agent.groupBy("scenario_id").agg(F.min("agent_idx").alias("_first"))
    return agent.join(first, "scenario_id").withColumn("mark_as_expert", F.col("agent_idx") != F.col("_first")).drop("_first")


def mark_eval_agents(agent: DataFrame, scenario: DataFrame) -> DataFrame:
    """is_track_to_predict by object index, from the scenario's index list."""
    wanted = scenario.select("scenario_id", F.explode("tracks_to_predict").alias("agent_idx")).distinct().withColumn("_w", F.lit(True))
    return agent.join(wanted, ["scenario_id", "agent_idx"], "left").withColumn("is_track_to_predict", F.coalesce("_w", F.lit(False))).drop("_w")


# Control and initialisation modes.
CONTROL_MODES = ("vehicles", "agents", "evaluation", "sdc_only", "mixed")


def select_agents(
    agent: DataFrame, state: DataFrame, scenario: DataFrame, init_mode: str = "all_valid", control_mode: str = "agents", init_step: int = 0,
    max_agents: int = 32, control_limit: int = 32, min_goal: float = 2.0,
) -> DataFrame:
    """Role of every created agent: 'active', 'static' or 'expert_static'; the recording vehicle comes first.

    The order inside a scenario is resolved with running counts over its objects (a few hundred at most).
    """
    at = state.filter(F.col("step") == init_step).select("scenario_id", "agent_idx", "valid")
    origin = state.filter("step = 0").select("scenario_id", "agent_idx", F.col("x").alias("_x"), F.col("y").alias("_y"))
    a = agent.join(at, ["scenario_id", "agent_idx"]).join(origin, ["scenario_id", "agent_idx"]).join(
        scenario.select("scenario_id", "sdc_track_index"), "scenario_id"
    )
    sdc = F.col("agent_idx") == F.col("sdc_track_index")
    known = F.col("object_type").isin(1, 2, 3)
    wanted = F.lit(True) if init_mode == "all_valid" else ((F.col("object_type") == 1) if control_mode == "vehicles" else known)
    by_scene = Window.partitionBy("scenario_id").orderBy(F.when(sdc, 0).otherwise(1), "agent_idx")
    run = by_scene.rowsBetween(Window.unboundedPreceding, 0)
    made = a.filter(sdc | (F.col("valid") & wanted)).withColumn("_n", F.row_number().over(by_scene)).filter(F.col("_n") <= max_agents)
    far = F.hypot(F.col("goal_x") - F.col("_x"), F.col("goal_y") - F.col("_y")) >= min_goal
    eligible = {
        "sdc_only": F.lit(False), "evaluation": known,
        "vehicles": (F.col("object_type") == 1) & ~F.col("mark_as_expert") & far,
    }.get(control_mode, known & ~F.col("mark_as_expert") & far)
    made = made.withColumn("_can", sdc | eligible).withColumn("_rank", F.sum(F.col("_can").cast("int")).over(run))
    made = made.withColumn("_on", F.col("_can") & (sdc | (F.col("_rank") <= control_limit)))
    full = F.sum(F.col("_on").cast("int")).over(run) >= control_limit
    role = F.when(F.col("_on"), "active").when(F.col("mark_as_expert") | full, "expert_static").otherwise("static")
    out = made.withColumn("role", role)
    if init_mode == "only_controllable":
        out = out.filter("role = 'active'")
    return out.select("scenario_id", "agent_idx", "role")
