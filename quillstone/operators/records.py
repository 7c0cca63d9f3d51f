"""The life of files and what belongs to them, as functions of the old tables and the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.catalog import first_by
from quillstone.functions.text import short_id, slug
from quillstone.operators.merges import add_to_counter, truncate_bytes, upsert

#: Prefixes of tags that users can't give, and of those that name a collection.
RESERVED = ("agent:", "instill-")
COLLECTION = "agent:collection:"
#: States that a file may be processed from again; systems that can't be removed; counters of a batch's usage.
REPROCESSABLE = ("FILE_PROCESS_STATUS_FAILED", "FILE_PROCESS_STATUS_NOTSTARTED", "FILE_PROCESS_STATUS_UNSPECIFIED")
PROTECTED = ("openai", "gemini")
USAGE = ("promptTokenCount", "candidatesTokenCount", "totalTokenCount", "cachedContentTokenCount", "callCount")
#: What a converted file must have.
REQUIRED = ("file_uid", "knowledge_base_uid", "storage_path", "content_type", "converted_type")


def reserved(tags: Column) -> Column:
    """Whether a tag has a prefix that the system keeps for itself."""
    return F.coalesce(F.exists(tags, lambda t: F.startswith(t, F.lit(RESERVED[0])) | F.startswith(t, F.lit(RESERVED[1]))), F.lit(False))


def collection_ids(tags: Column) -> Column:
    """Ids in the tags that name collections, in order; empty ones are left out."""
    own = F.transform(F.filter(tags, lambda t: F.startswith(t, F.lit(COLLECTION))), lambda t: F.substr(t, F.lit(len(COLLECTION) + 1)))
    return F.filter(F.coalesce(own, F.array().cast("array<string>")), lambda x: x != "")


def fresh_contents(held: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """New files whose content the knowledge base doesn't have yet, each content once."""
    key = ["kb_uid", "content_sha256"]
    return first_by(new, key, order).join(held.select(*key), key, "left_anti")


def create_files(files: DataFrame, links: DataFrame, kbs: DataFrame, new: DataFrame, order: list[Column], dedup: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, links and kbs with the new files: each is linked to its base, whose usage grows by its size. Without dedup as an administrator does it: usage stays."""
    if dedup:
        held = links.join(files.where("delete_time is null").select(F.col("uid").alias("file_uid"), "content_sha256"), "file_uid").select("kb_uid", "content_sha256")
        new = fresh_contents(held, new, order)
        kbs = add_to_counter(kbs, new.select(F.col("kb_uid").alias("uid"), "size"), "uid", "usage", "size")
    return files.unionByName(new.select(*files.columns)), links.unionByName(new.select(F.col("uid").alias("file_uid"), "kb_uid")), kbs


def delete_file(files: DataFrame, links: DataFrame, kbs: DataFrame, uid: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """files with the file deleted softly, and kbs with its size taken from the usage of every base it is linked to."""
    own = files.where(F.col("uid") == uid).select(F.col("uid").alias("file_uid"), "size")
    less = links.join(own, "file_uid").select(F.col("kb_uid").alias("uid"), (-F.col("size")).alias("size"))
    gone = F.when((F.col("uid") == uid) & F.col("delete_time").isNull(), now).otherwise(F.col("delete_time"))
    return files.withColumn("delete_time", gone), add_to_counter(kbs, less, "uid", "usage", "size")


def backfilled(files: DataFrame) -> DataFrame:
    """file_type without the prefix that it once had, and slug, where it is null or empty, from the name."""
    missing = F.coalesce("slug", F.lit("")) == ""
    return files.withColumn("file_type", F.regexp_replace("file_type", "^FILE_(TYPE_)", "$1")).withColumn("slug", F.when(missing, slug(F.col("display_name"))).otherwise(F.col("slug")))


def active_collections(kbs: DataFrame) -> DataFrame:
    """uid, collection: the collection that a base's vectors are in; one that isn't set, or is the nil uid, is the base's own."""
    set_ = F.nullif(F.nullif(F.col("active_collection_uid"), F.lit("")), F.lit("00000000-0000-0000-0000-000000000000"))
    return kbs.select("uid", F.coalesce(set_, "uid").alias("collection"))


def delete_with_twins(files: DataFrame, links: DataFrame, targets: DataFrame, uids: list[str], now: Column) -> DataFrame:
    """files with those of the uids deleted softly, and in each base's other copy (targets: uid, target) the live files of the same name."""
    gone = files.where(F.col("uid").isin(*uids) & F.col("delete_time").isNull()).select(F.col("uid").alias("file_uid"), "display_name")
    sides = links.join(gone, "file_uid").join(targets.where("target is not null").select(F.col("uid").alias("kb_uid"), "target"), "kb_uid").select(F.col("target").alias("kb_uid"), "display_name")
    twins = links.join(sides, "kb_uid").join(files.where("delete_time is null").select(F.col("uid").alias("file_uid"), F.col("display_name").alias("name")), "file_uid").where("name = display_name").select("file_uid")
    all_ = gone.select("file_uid").unionByName(twins).distinct().withColumn("hit_", F.lit(True))
    out = files.join(all_, F.col("uid") == F.col("file_uid"), "left")
    return out.withColumn("delete_time", F.when(F.col("hit_"), F.coalesce("delete_time", now)).otherwise(F.col("delete_time"))).select(*files.columns)


def with_field(json: Column, name: str, value: Column) -> Column:
    """A JSON object's text with a string field set, all other values as they are; null counts as the empty object.

    To an array the object is appended, a plain value becomes the first of an array; text that is no JSON stays.
    """
    text = F.coalesce(json, F.lit("{}"))
    parsed = F.try_parse_json(text)
    of = lambda start: F.startswith(F.schema_of_variant(parsed), F.lit(start))
    field = F.map_from_arrays(F.array(F.lit(name)), F.array(F.variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant")))
    merged = F.to_json(F.map_concat(F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, _: k != name), field))
    many = F.when(of("ARRAY"), F.from_json(text, "array<variant>")).otherwise(F.array(parsed))
    appended = F.to_json(F.concat(many, F.array(F.parse_json(F.to_json(field)))))
    return F.when(parsed.isNull(), text).when(of("OBJECT"), merged).otherwise(appended)


def begin_processing(files: DataFrame, uids: DataFrame, requester: str) -> DataFrame:
    """Files of the given uids are being processed for the requester; the message of their last status is cleared."""
    out = files.join(uids.select("uid", F.lit(True).alias("hit_")).distinct(), "uid", "left")
    hit = F.coalesce("hit_", F.lit(False))
    return out.withColumns({
        "process_status": F.when(hit, "FILE_PROCESS_STATUS_PROCESSING").otherwise(F.col("process_status")),
        "requester_uid": F.when(hit, requester).otherwise(F.col("requester_uid")),
        "extra_meta_data": F.when(hit, with_field(F.col("extra_meta_data"), "status_message", F.lit(""))).otherwise(F.col("extra_meta_data")),
    }).select(*files.columns)


def update_row(old: DataFrame, key: str, value, column: str, new) -> DataFrame:
    """One column of one row set."""
    return old.withColumn(column, F.when(F.col(key) == value, F.lit(new)).otherwise(F.col(column)))


def replace_column(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """The column as the new rows have it, nulls too; other rows keep theirs."""
    own = new.select(key, F.col(column).alias("new_"), F.lit(True).alias("hit_"))
    return old.join(own, key, "left").withColumn(column, F.when(F.col("hit_"), F.col("new_")).otherwise(F.col(column))).select(*old.columns)


def converted_get_or_create(held: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """held with the new converted files; of a file and type that is there already the old one stays. A missing required field is an error."""
    lacks = F.lit(False)
    for c in REQUIRED:
        lacks = lacks | F.coalesce(F.col(c).cast("string"), F.lit("")).eqNullSafe("")
    if not (bad := new.where(lacks)).isEmpty():
        raise ValueError(f"{', '.join(REQUIRED)} are required: {bad.first()}")
    key = ["file_uid", "converted_type"]
    return held.unionByName(first_by(new, key, order).join(held.select(*key), key, "left_anti").select(*held.columns))


def upsert_vectors(held: DataFrame, new: DataFrame, most: int = 65_535) -> DataFrame:
    """By uid; texts are cut to so many bytes. A collection that isn't there is one without rows."""
    return upsert(held, new.withColumn("text", truncate_bytes("text", most)), ["uid"])


def retag(vectors: DataFrame, files: DataFrame) -> DataFrame:
    """Vectors with the tags that their files have now; files: file_uid, tags."""
    return replace_column_by(vectors, files, "file_uid", "tags")


def replace_column_by(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    return replace_column(old, new.dropDuplicates([key]), key, column)


def without_files(rows: DataFrame, uids: DataFrame, key: str = "file_uid") -> DataFrame:
    """Rows of other files; uids: a column of the same name."""
    return rows.join(uids.select(key), key, "left_anti")


def delete_converted(converted: DataFrame, chunks: DataFrame, files: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """converted and chunks without those of the files, of the given types only if any are given; chunks go with the converted file they were made of."""
    old = converted.join(files.select("file_uid"), "file_uid", "left_semi")
    old = old.where(F.col("converted_type").isin(*only)) if only else old
    gone = old.select("uid")
    return converted.join(gone, "uid", "left_anti"), chunks.join(gone.withColumnRenamed("uid", "source_uid"), "source_uid", "left_anti")


def delete_some(rows: DataFrame, where: Column, order: list[Column], most: int) -> DataFrame:
    """rows without the first `most` that the condition holds for: one batch of a purge."""
    return rows.join(rows.where(where).orderBy(*order).limit(most).select("uid"), "uid", "left_anti")


def reprocessable(status: Column) -> Column:
    return status.isin(*REPROCESSABLE)


def reset(files: DataFrame, links: DataFrame, kb: str) -> DataFrame:
    """Files of a base that haven't been deleted wait to be processed again."""
    own = links.where(F.col("kb_uid") == kb).select(F.col("file_uid").alias("uid"), F.lit(True).alias("hit_")).distinct()
    out = files.join(own, "uid", "left")
    hit = F.coalesce("hit_", F.lit(False)) & F.col("delete_time").isNull()
    return out.withColumn("process_status", F.when(hit, "FILE_PROCESS_STATUS_NOTSTARTED").otherwise(F.col("process_status"))).select(*files.columns)


def patch_only(extra: Column, status: Column) -> Column:
    """Whether a file that is done only gets a patch: its metadata say so."""
    return (F.get_json_object(extra, "$.x-instill-patch") == "true") & (status == "FILE_PROCESS_STATUS_COMPLETED")


def alias_backfill(first_augmented: Column, summary: Column) -> Column:
    """Whether aliases are to be put in: the first augmented chunk has none yet, and there is a summary to make them from."""
    return ~F.coalesce(F.contains(first_augmented, F.lit(" (")), F.lit(False)) & summary.isNotNull()


def one_running(starts: DataFrame, key: str = "file_uid") -> DataFrame:
    """Starts that are let in: at each, no start let in before still runs. Columns: key, at, until (null: it still runs), uid.

    A start is judged by those let in before it, which isn't a window over all rows; it is a fold over one key's starts.
    """
    held = starts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "uid", "until"))).alias("x"))
    none = F.struct(F.lit(None).cast("timestamp").alias("busy"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("uids"))

    def step(a: Column, s: Column) -> Column:
        free = ~a["open"] & (a["busy"].isNull() | (a["busy"] <= s["at"]))
        return F.when(free, F.struct(s["until"].cast("timestamp").alias("busy"), s["until"].isNull().alias("open"), F.concat(a["uids"], F.array(s["uid"])).alias("uids"))).otherwise(a)

    return held.select(key, F.explode(F.aggregate("x", none, step, lambda a: a["uids"])).alias("uid"))


def batch_usage(batches: DataFrame, key: str, usage: str) -> DataFrame:
    """Sums of the five counters in a JSON text, missing or unreadable ones as zero."""
    return batches.groupBy(key).agg(*(F.sum(F.coalesce(F.get_json_object(usage, f"$.{c}").try_cast("double").cast("long"), F.lit(0))).alias(c) for c in USAGE))


def put_tag(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Repository tags by name: the digest and time of the new ones; put_tag twice is once."""
    return upsert(tags, new, ["name"])


def drop_digest(tags: DataFrame, repository: str, digest: str) -> DataFrame:
    """Without the tags of a repository that stand for a digest."""
    return tags.where(~(F.startswith("name", F.lit(f"repositories/{repository}/tags/")) & (F.col("digest") == digest)))


def default_system(systems: DataFrame) -> DataFrame:
    """One row: the default system, the first by key if there are several, else the one with the slug openai."""
    ranked = systems.where("delete_time is null").withColumn("rank_", F.when(F.col("is_default"), 0).when(F.col("slug") == "openai", 1))
    return ranked.where("rank_ is not null").orderBy("rank_", "uid").limit(1).drop("rank_")


#: What a system without a configuration of its own embeds with.
MODEL_FAMILY, DIMENSIONS, FALLBACK = "openai", 1536, "openai"


def configured(systems: DataFrame) -> DataFrame:
    """systems and model_family and dimensionality of their config (JSON); without config.rag.embedding the fixed ones.

    In an embedding that is there a family that is no text is empty, and a dimensionality that is no number is 0.
    """
    config = F.try_parse_json("config")
    at = lambda path: F.try_variant_get(config, path, "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(at(path)), F.lit(""))
    there = F.startswith(kind("$.rag.embedding"), F.lit("OBJECT"))
    family = F.when(kind("$.rag.embedding.model_family") == "STRING", F.try_variant_get(config, "$.rag.embedding.model_family", "string")).otherwise("")
    size = F.when(kind("$.rag.embedding.dimensionality").rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(config, "$.rag.embedding.dimensionality", "double").cast("long")).otherwise(0)
    return systems.withColumn("model_family", F.when(there, family).otherwise(MODEL_FAMILY)).withColumn("dimensionality", F.when(there, size).otherwise(DIMENSIONS).cast("long"))


def configs_of(asked: DataFrame, systems: DataFrame) -> DataFrame:
    """asked (system_id), with model_family and dimensionality: of the live system of that id, else of the fallback's slug, else the fixed ones."""
    own = configured(systems.where("delete_time is null"))
    fallback = own.where(F.col("slug") == FALLBACK).orderBy("uid").limit(1).agg(F.first("model_family").alias("f_"), F.first("dimensionality").alias("d_"))  # one row
    by_id = own.groupBy(F.col("id").alias("system_id")).agg(F.min_by(F.struct("model_family", "dimensionality"), "uid").alias("own_"))
    out = asked.join(by_id, "system_id", "left").crossJoin(F.broadcast(fallback))
    pick = lambda c, f, fixed: F.coalesce(F.when(F.col("own_").isNotNull(), F.col(f"own_.{c}")).otherwise(F.col(f)), F.lit(fixed)).alias(c)
    return out.select(*asked.columns, pick("model_family", "f_", MODEL_FAMILY), pick("dimensionality", "d_", DIMENSIONS))


def create_systems(systems: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """systems with new ones (uid, display_name, config, description): none is the default, id and slug come from uid and name."""
    made = new.select("uid", short_id("sys", F.col("uid")).alias("id"), slug(F.col("display_name")).alias("slug"), "display_name", "config", "description", F.lit(False).alias("is_default"), now.alias("create_time"), now.alias("update_time"), F.lit(None).cast("timestamp").alias("delete_time"))
    return systems.unionByName(made.select(*systems.columns))


def update_systems(systems: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Columns of changes (id and some others) that are not null replace those of the live system of that id; an id that isn't there is an error."""
    live = systems.where("delete_time is null")
    if not (bad := changes.join(live.select("id"), "id", "left_anti")).isEmpty():
        raise ValueError(f"no system {bad.first()['id']}")
    fields = [c for c in changes.columns if c != "id"]
    told = changes.select(F.col("id").alias("id_"), *(F.col(c).alias(f"{c}_") for c in fields), F.lit(True).alias("hit_"))
    out = systems.join(told, (F.col("id") == F.col("id_")) & F.col("delete_time").isNull(), "left")
    return out.withColumns({c: F.coalesce(f"{c}_", c) for c in fields}).withColumn("update_time", F.when(F.col("hit_"), now).otherwise(F.col("update_time"))).select(*systems.columns)


def rename_system(systems: DataFrame, id_: str, name: str) -> DataFrame:
    """The name of one system and the slug that is made of it; protected systems keep theirs, with an error."""
    if not systems.where((F.col("id") == id_) & F.col("slug").isin(*PROTECTED)).isEmpty():
        raise ValueError(f"{id_} is protected")
    hit = F.col("id") == id_
    made = F.regexp_replace(F.replace(F.lower(F.lit(name)), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "")
    return systems.withColumn("display_name", F.when(hit, name).otherwise(F.col("display_name"))).withColumn("slug", F.when(hit, made).otherwise(F.col("slug")))


def drop_system(systems: DataFrame, slug: str, now: Column) -> DataFrame:
    """Softly; protected systems and the default one stay, with an error."""
    if slug in PROTECTED:
        raise ValueError(f"{slug} is protected")
    if not systems.where((F.col("slug") == slug) & F.col("is_default")).isEmpty():
        raise ValueError(f"{slug} is the default")
    return systems.withColumn("delete_time", F.when((F.col("slug") == slug) & F.col("delete_time").isNull(), now).otherwise(F.col("delete_time")))


def create_base(kbs: DataFrame, new: DataFrame, scope: str = "owner") -> DataFrame:
    """kbs with the new ones; a slug that the scope already has in use is an error."""
    taken = kbs.where("delete_time is null").select(scope, "slug")
    if not (bad := new.join(taken, [scope, "slug"], "left_semi")).isEmpty():
        raise ValueError(f"the slug is in use: {bad.first()}")
    return kbs.unionByName(new.select(*kbs.columns))


def clean_base(tables: dict[str, DataFrame], uid: str) -> dict[str, DataFrame]:
    """All tables with a kb_uid without a base's rows; files stay while another base links them."""
    out = {t: d.where(F.col("kb_uid") != uid) if "kb_uid" in d.columns else d for t, d in tables.items()}
    if "files" in out and "links" in out:
        mine = tables["links"].where(F.col("kb_uid") == uid).select(F.col("file_uid").alias("uid"))
        orphaned = mine.join(out["links"].select(F.col("file_uid").alias("uid")), "uid", "left_anti")
        out["files"] = out["files"].join(orphaned, "uid", "left_anti")
    return out
