"""Matching by formula: one source against all others, all sources, or changed records only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.strings import column, indel_ratio, token_set_ratio
from kinloom.operators import formula as fx
from kinloom.sources.stage import Stage

#: Records of one key on either side that meet in one piece; larger blocks are cut on both sides, piece against piece.
BLOCK = 2_000


def formula_block_keys(df: DataFrame, formula: fx.Formula) -> Column:
    """Keys of a record: the initial of each Chinese field's reading, three letters of the first long enough English field; ``__all__`` without any."""
    spark, available = df.sparkSession, set(df.columns)
    parts = []
    for f in formula.chinese_fields():
        text = F.trim(F.coalesce(F.col(f), F.lit(""))) if f in available else F.lit("")
        initial = F.upper(F.left(F.trim(fx.syllables(spark)(text)), F.lit(1)))
        parts.append(F.when(text != "", F.concat(F.lit(f"cn_{f}_"), F.when(initial == "", "#").otherwise(initial))))
    english = [F.lower(F.trim(F.coalesce(F.col(f), F.lit("")))) for f in formula.english_fields() if f in available]
    long = [F.when(F.length(e) >= 2, F.concat(F.lit("en_"), F.left(e, F.lit(3)))) for e in english]
    if long:
        parts.append(F.coalesce(*long))
    keys = F.array_distinct(F.array_compact(F.array(*parts))) if parts else F.array().cast("array<string>")
    return F.when(F.size(keys) == 0, F.array(F.lit("__all__"))).otherwise(keys)


def latest_by_key(df: DataFrame) -> DataFrame:
    """One row per source key: the latest modified, then the greatest record_id."""
    row = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy("ccd_source_key").agg(F.max_by(row, F.struct("modified", "record_id")).alias("r")).select("r.*")


def prepared(master: DataFrame, formula: fx.Formula) -> DataFrame:
    """What every record contributes to a formula: its ids, its slots and ``_keys``, its block keys."""
    ready = fx.prepare(master, formula).withColumn("_keys", formula_block_keys(master, formula))
    made = [c for c in ready.columns if c.startswith(("_f", "_y"))]
    return ready.select("record_id", "source", "ccd_source_key", "modified", *made, "_keys")


def _meetings(own: DataFrame, others: DataFrame) -> DataFrame:
    """Every pair of ``own`` (columns l_..) and ``others`` (r_..) that shares a key, once.

    A block is cut into pieces of about ``BLOCK`` records on both sides and every
    piece meets every other, so a hot key spreads over tasks and loses no pair.  A
    pair of several common keys is made at the least of them.
    """
    sides = {"l": own.withColumn("_key", F.explode("l_keys")), "r": others.withColumn("_key", F.explode("r_keys"))}
    n = {s: df.groupBy("_key").agg(F.count(F.lit(1)).alias(f"_n{s}")) for s, df in sides.items()}
    sizes = n["l"].join(n["r"], "_key")
    pairs = sizes.agg(F.sum(F.col("_nl") * F.col("_nr"))).first()[0] or 0
    tasks = max(2 * own.sparkSession.sparkContext.defaultParallelism, -(-pairs // BLOCK**2))
    cuts = sizes.select("_key", *(F.ceil(F.col(f"_n{s}") / BLOCK).cast("int").alias(f"_c{s}") for s in "lr"))
    ready = []
    for s, o in (("l", "r"), ("r", "l")):
        piece = F.pmod(F.xxhash64(f"{s}_record_id"), F.col(f"_c{s}")).cast("int")
        cut = sides[s].join(cuts, "_key").withColumn(f"_p{s}", piece).withColumn(f"_p{o}", F.explode(F.sequence(F.lit(0), F.col(f"_c{o}") - 1)))
        ready.append(cut.drop("_cl", "_cr").repartition(tasks, "_key", "_pl", "_pr"))
    met = ready[0].join(ready[1], ["_key", "_pl", "_pr"]).filter(F.array_min(F.array_intersect("l_keys", "r_keys")) == F.col("_key"))
    return met.drop("_key", "_pl", "_pr", "l_keys", "r_keys")


def match_source(master: DataFrame, source: str, text: str, *, changed: DataFrame | None = None, limit: int | None = None, ready: DataFrame | None = None) -> DataFrame:
    """(parent, mas_client, client, client_id, idx, score, match_equation) of one source's records against all others.

    ``changed`` (ccd_source_key) restricts the source's records by a semi-join;
    ``limit`` takes the first so many by record_id.  A record of a null or equal
    source is no candidate.  An empty formula matches nothing.  ``idx`` numbers the
    matches of a parent from the best score down.  ``ready`` is the written
    :func:`prepared` of ``master``, where it is at hand.
    """
    empty = "parent string, mas_client string, client string, client_id string, idx int, score double, match_equation string"
    if not (text or "").strip():
        return master.sparkSession.createDataFrame([], empty)
    formula = fx.parse(text)
    if ready is None:
        ready = Stage(master.sparkSession, "formula").write(prepared(master, formula))
    own = latest_by_key(ready.filter(F.col("source") == source))
    if changed is not None:
        own = own.join(changed.select("ccd_source_key").distinct(), "ccd_source_key", "left_semi")
    if limit is not None:
        own = own.orderBy("record_id").limit(limit)
    others = ready.filter((F.col("source") != source) & (F.col("source") != ""))
    sides = [df.select(*(F.col(c).alias(f"{side}{c}" if c.startswith("_") and c != "_keys" else f"{side}_{c.lstrip('_')}") for c in ready.columns if c != "modified")) for side, df in (("l", own), ("r", others))]
    scored = _meetings(*sides)
    for i in range(len(formula.slots)):
        scored = scored.withColumn(f"_s{i}", fx.slot_scores(formula)[i])
    scores = [F.col(f"_s{i}") for i in range(len(formula.slots))]
    score, matches = fx.evaluate(formula, scores)
    found = scored.withColumn("_score", score).filter(matches).dropDuplicates(["l_record_id", "r_record_id"])
    order = Window.partitionBy("l_record_id").orderBy(F.desc("_score"), "r_source", "r_ccd_source_key", "r_record_id")
    return found.select(
        F.col("l_record_id").alias("parent"),
        F.col("l_source").alias("mas_client"),
        F.col("r_source").alias("client"),
        F.col("r_ccd_source_key").alias("client_id"),
        F.row_number().over(order).alias("idx"),
        F.col("_score").alias("score"),
        fx.audit_html(formula, scores, F.col("_score")).alias("match_equation"),
    )


def match_all(master: DataFrame, registrations: DataFrame, *, changed: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Matches of every source with a formula, and the sources whose formula failed, with the reason.

    ``changed`` (source, ccd_source_key) restricts the records that are matched.
    Records are prepared once for all formulas of the same slots.
    """
    stage, ready = Stage(master.sparkSession, "formula"), {}
    done, failed = [], {}
    for r in registrations.select("source", "fuzzymachingscript").collect():  # a configuration table
        source, text = r["source"], (r["fuzzymachingscript"] or "").strip()
        try:
            slots = fx.parse(text).slots if text else None
            if text and slots not in ready:
                ready[slots] = stage.write(prepared(master, fx.parse(text)))
            own = None if changed is None else changed.filter(F.col("source") == source)
            done.append(match_source(master, source, text, changed=own, limit=limit, ready=ready.get(slots)))
        except ValueError as problem:
            failed[source] = str(problem)
    return (reduce(DataFrame.unionByName, done) if done else None), failed


def replace_matches(stored: DataFrame, fresh: DataFrame, processed: DataFrame) -> DataFrame:
    """The match table after a run: rows of processed parents are replaced by the fresh ones."""
    kept = stored.join(processed.select("parent").distinct(), "parent", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def directional_baseline(pairs: DataFrame, master: DataFrame, registrations: DataFrame) -> DataFrame:
    """(left_id, right_id, score, matches, direction): the better of both sides' formulas; without any, no row.

    ``pairs`` has left_id, right_id, left_source, right_source.  Equal scores go to
    the left side's formula; a match in either direction is a match.
    """
    parts = []
    for r in registrations.filter("coalesce(fuzzymachingscript, '') <> ''").collect():  # a configuration table
        formula = fx.parse(r["fuzzymachingscript"])
        ready = fx.prepare(master, formula)
        made = [c for c in ready.columns if c.startswith(("_f", "_y"))]
        for side, other, rank in (("left", "right", 1), ("right", "left", 0)):
            own = pairs.filter(F.col(f"{side}_source") == r["source"]).select("left_id", "right_id")
            a = ready.select(F.col("record_id").alias(f"{side}_id"), *(F.col(c).alias(f"l{c}") for c in made))
            b = ready.select(F.col("record_id").alias(f"{other}_id"), *(F.col(c).alias(f"r{c}") for c in made))
            both = own.join(a, f"{side}_id").join(b, f"{other}_id")
            for i in range(len(formula.slots)):
                both = both.withColumn(f"_s{i}", fx.slot_scores(formula)[i])
            score, matches = fx.evaluate(formula, [F.col(f"_s{i}") for i in range(len(formula.slots))])
            parts.append(both.select("left_id", "right_id", score.alias("score"), matches.alias("matches"), F.lit(f"{side}_source_formula").alias("direction"), F.lit(rank).alias("rank")))
    if not parts:
        return pairs.sparkSession.createDataFrame([], "left_id string, right_id string, score double, matches boolean, direction string")
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("left_id", "right_id").agg(F.max("score").alias("score"), F.max("matches").alias("matches"), F.max_by("direction", F.struct("score", "rank")).alias("direction"))


def baseline_with_formulas(pairs: DataFrame, master: DataFrame, registrations: DataFrame) -> DataFrame:
    """``pairs`` with score, matches and direction of :func:`directional_baseline`; a pair without formula keeps its own score and matches, direction ``default``.

    ``pairs`` has left_id, right_id, left_source, right_source, score, matches; other columns stay.
    """
    own = directional_baseline(pairs.select("left_id", "right_id", "left_source", "right_source").distinct(), master, registrations)
    own = own.select("left_id", "right_id", F.col("score").alias("_score"), F.col("matches").alias("_matches"), F.col("direction").alias("_direction"))
    joined = pairs.join(own, ["left_id", "right_id"], "left")
    return joined.withColumns({"score": F.coalesce("_score", "score"), "matches": F.coalesce("_matches", "matches"), "direction": F.coalesce("_direction", F.lit("default"))}).drop("_score", "_matches", "_direction")


def legacy_macros() -> dict:
    """Two-argument Column functions of the four macros, for use outside formulas."""

    def english(a: Column, b: Column) -> Column:
        x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
        return F.when((F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == ""), 0.0).when(x == y, 1.0).otherwise(column(token_set_ratio, x, y))

    def phone(a: Column, b: Column) -> Column:
        x, y = fx.legacy_phone(a), fx.legacy_phone(b)
        return F.when((F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == ""), 0.0).when(x == y, 1.0).otherwise(column(indel_ratio, x, y))

    def identifier(a: Column, b: Column) -> Column:
        x, y = (F.regexp_replace(F.upper(F.trim(c)), r"[\s\-]", "") for c in (a, b))
        return F.when((x == y) & (x != ""), 1.0).otherwise(0.0)

    return {"english_match": english, "phone_match": phone, "id_match": identifier}
