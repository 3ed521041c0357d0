"""Changes to the catalogue as DataFrame -> DataFrame functions; ``plans.store`` writes their results.

Parquet has no row updates, so each is one equi-join of the table with what comes in and one new snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_error
from ..schemas import PALETTE_VERSION, ROLES, SLOTS, TITLES, TVDB_TITLES
from .ranking import interleaved_rank, listed

KEY_A, KEY_B = ["media_type", "tmdb_id"], ["kind", "tvdb_id"]
COLOURS = [*[f"{s}_{x}" for s in SLOTS for x in ("hex", "ratio")], *[f"{r}_hex" for r in ROLES]]


def now() -> Column:
    """UTC to the second as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def conform(df: DataFrame, schema) -> DataFrame:
    """``df`` with all columns of a schema, in order; missing ones are null (a table from before they were added)."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _sides(table: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Both rows of each key, in structs ``o`` and ``n``, and the key's columns."""
    old = table.select(*[F.col(k).alias(f"o_{k}") for k in key], F.struct(*table.columns).alias("o"))
    new = incoming.select(*[F.col(k).alias(f"n_{k}") for k in key], F.struct(*incoming.columns).alias("n"))
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in key]
    return old.join(new, on, "full_outer").select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in key], "o", "n")


def seed(table: DataFrame, incoming: DataFrame, at: Column | None = None) -> DataFrame:
    """Titles of an export (media_type, tmdb_id, title, adult, popularity[, ordinal]) into the table.

    New ones are pending. Known ones take adult and popularity, and the title if they have none, if any of that
    changes. Rows of one key count in the order of ``ordinal``: the last adult and popularity, the first title.
    """
    at = now() if at is None else at
    place = F.col("ordinal") if "ordinal" in incoming.columns else F.lit(0)
    last = lambda c: F.max_by(F.struct(c), place).getField(c).alias(c)  # noqa: E731  the struct keeps a last null
    given = incoming.groupBy(*KEY_A).agg(F.min_by("title", F.when(F.col("title").isNotNull(), place)).alias("title"), last("adult"), last("popularity"))
    x = _sides(table, given, KEY_A)
    fresh = F.col("o").isNull() & F.col("n").isNotNull()
    differs = ~F.col("o.popularity").eqNullSafe(F.col("n.popularity")) | ~F.col("o.adult").eqNullSafe(F.col("n.adult")) | F.col("o.title").isNull()
    hit = F.col("o").isNotNull() & F.col("n").isNotNull() & differs
    out = {f.name: F.col(f"o.{f.name}") for f in TITLES.fields} | {k: F.col(k) for k in KEY_A}
    out["title"] = F.when(fresh, F.col("n.title")).when(hit, F.coalesce("o.title", "n.title")).otherwise(F.col("o.title"))
    for c in ("adult", "popularity"):
        out[c] = F.when(fresh | hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    out["adult"] = F.coalesce(out["adult"], F.lit(0))
    out["status"] = F.when(fresh, "pending").otherwise(F.col("o.status"))
    out["attempts"] = F.when(fresh, 0).otherwise(F.col("o.attempts"))
    out["updated_at"] = F.when(fresh, at).otherwise(F.col("o.updated_at"))
    return x.select(*[out[f.name].cast(f.dataType).alias(f.name) for f in TITLES.fields])


def requeue(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Titles with changed ids (media_type, tmdb_id): done ones lose their version, others are pending; attempts are 0."""
    hit = ids.select(*KEY_A).distinct().withColumn("_hit", F.lit(True))
    x, got = table.join(hit, KEY_A, "left"), F.coalesce("_hit", F.lit(False))
    done = F.col("status") == "done"
    x = x.withColumns({
        "palette_version": F.when(got & done, None).otherwise(F.col("palette_version")),
        "attempts": F.when(got, 0).otherwise(F.col("attempts")),
        "status": F.when(got & ~done, "pending").otherwise(F.col("status")),
    })
    return x.select(*table.columns)


def prune(table: DataFrame, size: int, include_adult: bool = False) -> DataFrame:
    """Without the titles that are neither done nor among the first ``size`` ranks."""
    keep = interleaved_rank(listed(table, include_adult)).where(F.col("rank") <= size).select(*KEY_A)
    return table.where(F.col("status") == "done").unionByName(table.where(F.col("status") != "done").join(keep, KEY_A, "left_semi"))


def keep_top(export: DataFrame, size: int, include_adult: bool = False) -> DataFrame:
    """The titles of an export among the first ``size`` ranks."""
    return interleaved_rank(listed(export, include_adult)).where(F.col("rank") <= size).drop("rank")


def last_of_each(results: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key: the last by ``ordinal``, if there is one, and of equal ones the greatest by its values."""
    place = [F.col("ordinal")] if "ordinal" in results.columns else []
    row = F.struct(*[c for c in results.columns if c not in key])
    return results.groupBy(*key).agg(F.max_by(row, F.struct(*place, *[F.col(c).cast("string") for c in results.columns if c not in key])).alias("r")).select(*key, "r.*")


def save(table: DataFrame, results: DataFrame, at: Column | None = None) -> DataFrame:
    """Outcomes (key, status, and any of title, adult, error, poster_path, logo_path and colours) into the table.

    Unknown keys are inserted. All outcome columns are overwritten, so an error clears colours; title and adult only
    if given. An error adds an attempt, anything else sets 0; the version is set only with colours. Of several results
    of one title the last counts.
    """
    at = now() if at is None else at
    results = last_of_each(results, KEY_A)
    own = conform(results, TITLES).drop("attempts", "palette_version", "updated_at")
    if "adult" not in results.columns:
        own = own.withColumn("adult", F.lit(None).cast("int"))
    x = _sides(table, own, KEY_A)
    got = F.col("n").isNotNull()
    out = {f.name: F.col(f"o.{f.name}") for f in TITLES.fields} | {k: F.col(k) for k in KEY_A}
    for c in ("title", "adult"):
        out[c] = F.coalesce(f"n.{c}", f"o.{c}")
    out["adult"] = F.coalesce(out["adult"], F.lit(0))
    for c in ("poster_path", "logo_path", "status", *COLOURS):
        out[c] = F.when(got, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    out["error"] = F.when(got, short_error(F.col("n.error"))).otherwise(F.col("o.error"))
    tried = F.when(F.col("n.status") == "error", F.coalesce("o.attempts", F.lit(0)) + 1).otherwise(0)
    out["attempts"] = F.when(got, tried).otherwise(F.col("o.attempts"))
    version = F.when(F.col("n.primary_hex").isNotNull() | F.col("n.base_hex").isNotNull(), PALETTE_VERSION)
    out["palette_version"] = F.when(got, version).otherwise(F.col("o.palette_version"))
    out["updated_at"] = F.when(got, at).otherwise(F.col("o.updated_at"))
    return x.select(*[out[f.name].cast(f.dataType).alias(f.name) for f in TITLES.fields])


def next_generation(table: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, generation) of the next listing."""
    known = table.groupBy("kind").agg((F.coalesce(F.max("seen"), F.lit(0)) + 1).alias("g"))
    every = table.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(known, "kind", "left").select("kind", F.coalesce("g", F.lit(1)).cast("int").alias("generation"))


def seed_b(table: DataFrame, listing: DataFrame, at: Column | None = None) -> DataFrame:
    """A complete listing (kind, tvdb_id, title, score, image, seen[, ordinal]) into the second pipeline's table; of a
    title that is listed again the last row by ``ordinal`` counts.

    A changed image clears the version and attempts, and makes all but done titles pending, as does being listed
    again after not_found. Every rule reads the row as it was.
    """
    at = now() if at is None else at
    x = _sides(table, last_of_each(listing, KEY_B), KEY_B)
    fresh, got = F.col("o").isNull(), F.col("n").isNotNull()
    moved = got & ~fresh & ~F.col("o.image").eqNullSafe(F.col("n.image"))
    out = {f.name: F.col(f"o.{f.name}") for f in TVDB_TITLES.fields} | {k: F.col(k) for k in KEY_B}
    for c in ("title", "score", "image", "seen"):
        out[c] = F.when(got, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    out["palette_version"] = F.when(moved, None).otherwise(F.col("o.palette_version"))
    pending = fresh | (moved & (F.col("o.status") != "done")) | (got & (F.col("o.status") == "not_found"))
    out["status"] = F.when(pending, "pending").otherwise(F.col("o.status"))
    out["attempts"] = F.when(fresh | moved, 0).otherwise(F.col("o.attempts"))
    out["dirty"] = F.coalesce("o.dirty", F.lit(0))
    out["updated_at"] = F.when(fresh, at).otherwise(F.col("o.updated_at"))
    return x.select(*[out[f.name].cast(f.dataType).alias(f.name) for f in TVDB_TITLES.fields])


def sweep(table: DataFrame, listing: DataFrame, at: Column | None = None) -> DataFrame:
    """After a complete listing: what it doesn't have is not_found, and dirty if it was done. A kind that the listing
    has nothing of is left alone."""
    at = now() if at is None else at
    kinds = listing.select("kind").distinct().withColumn("_swept", F.lit(True))
    there = listing.select(*KEY_B).distinct().withColumn("_there", F.lit(True))
    x = table.join(F.broadcast(kinds), "kind", "left").join(there, KEY_B, "left")  # two kinds at most
    gone = F.col("_swept").isNotNull() & F.col("_there").isNull() & (F.col("status") != "not_found")
    x = x.withColumns({
        "dirty": F.when(gone & (F.col("status") == "done"), 1).otherwise(F.col("dirty")),
        "updated_at": F.when(gone, at).otherwise(F.col("updated_at")),
        "status": F.when(gone, "not_found").otherwise(F.col("status")),
    })
    return x.select(*table.columns)


def save_b(table: DataFrame, results: DataFrame, at: Column | None = None) -> DataFrame:
    """Outcomes into the second pipeline's table; unknown keys are ignored. The target needs the result (dirty) unless
    it is an error. Of several results of one title the last counts."""
    at = now() if at is None else at
    own = conform(last_of_each(results, KEY_B), TVDB_TITLES)
    new = own.select(*[F.col(k).alias(f"n_{k}") for k in KEY_B], F.struct("status", "error", "logo", *ROLES).alias("n"))
    x = table.join(new, [F.col(k) == F.col(f"n_{k}") for k in KEY_B], "left")
    got, status = F.col("n").isNotNull(), F.col("n.status")
    pick = lambda new, old: F.when(got, new).otherwise(F.col(old)).alias(old)
    new_columns = {
        "status": pick(status, "status"), "error": pick(short_error(F.col("n.error")), "error"),
        "attempts": pick(F.when(status == "error", F.col("attempts") + 1).otherwise(0), "attempts"),
        "palette_version": pick(F.when(status == "done", PALETTE_VERSION), "palette_version"),
        "dirty": pick(F.when(status.isin("done", "no_poster", "not_found"), 1).otherwise(F.col("dirty")), "dirty"),
        "updated_at": pick(at, "updated_at"), **{c: pick(F.col(f"n.{c}"), c) for c in ("logo", *ROLES)},
    }
    return x.select(*[new_columns.get(c, F.col(c)) for c in table.columns])


def palette_cache(table: DataFrame, version: int = PALETTE_VERSION) -> DataFrame:
    """(pair, role colours) of the pairs that are done in a version, one row each, the least by id."""
    from ..functions.text import pair_key

    done = table.where((F.col("status") == "done") & F.col("poster_path").isNotNull() & (F.col("palette_version") == version))
    rows = done.withColumn("pair", pair_key(F.col("poster_path"), F.col("logo_path")))
    best = F.min(F.struct("media_type", "tmdb_id", *[f"{r}_hex" for r in ROLES])).alias("b")
    return rows.groupBy("pair").agg(best).select("pair", *[F.col(f"b.{r}_hex").alias(f"{r}_hex") for r in ROLES])


def set_state(state: DataFrame, key: str, value: str) -> DataFrame:
    one = state.sparkSession.createDataFrame([(key, value)], state.schema)
    return state.where(F.col("key") != key).unionByName(one)


def get_state(state: DataFrame, key: str) -> str | None:
    row = state.where(F.col("key") == key).select("value").first()
    return row.value if row else None


def export_batches(table: DataFrame, most: int = 80_000, size: int = 500) -> DataFrame:
    """The dirty titles to send, best score first (nulls last, then key), in numbered batches, with payloads.

    The first ``most`` rows are taken as a bounded top-k; only they are numbered.
    """
    order = [F.col("score").desc_nulls_last(), F.col("kind"), F.col("tvdb_id")]
    first = table.where(F.col("dirty") == 1).orderBy(*order).limit(most)
    x = first.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))
    colours = F.when(F.col("status") == "done", F.struct(*ROLES))
    return x.select("kind", "tvdb_id", "score", "rn", F.floor((F.col("rn") - 1) / size).cast("long").alias("batch"), F.concat_ws(":", "kind", F.col("tvdb_id").cast("string")).alias("key"), colours.alias("colours"))


def payloads(batches: DataFrame) -> DataFrame:
    """(batch, items): each batch's JSON. A batch has a fixed number of rows."""
    item = F.struct("rn", F.to_json(F.struct("key", "colours"), {"ignoreNullFields": "false"}).alias("j"))
    listed_ = F.array_sort(F.collect_list(item))
    return batches.groupBy("batch").agg(listed_.alias("x")).select("batch", F.concat(F.lit('{"items":['), F.array_join("x.j", ","), F.lit("]}")).alias("items"))


def acknowledge(table: DataFrame, sent: DataFrame) -> DataFrame:
    """``table`` after the rows of ``sent`` arrived: they aren't dirty any more."""
    hit = sent.select(*KEY_B).distinct().withColumn("_sent", F.lit(True))
    x = table.join(hit, KEY_B, "left")
    return x.withColumn("dirty", F.when(F.col("_sent").isNotNull(), 0).otherwise(F.col("dirty"))).select(*table.columns)
