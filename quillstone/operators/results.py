"""From search hits to chunk rows: which rows of an index may be hit, and what is shown of a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.pages import reference

NIL = "00000000-0000-0000-0000-000000000000"


class NotFound(ValueError):
    pass


def real(uids: list[str]) -> list[str]:
    """Without nil uids; a list of nil ones only is no restriction, as the empty one is."""
    return [u for u in uids if u and u != NIL]


def hit_filter(index: DataFrame, file_uids: list[str] = (), file_type: str | None = None, content_type: str | None = None, chunk: str | None = None, tags: list[str] = (), file_names: list[str] = ()) -> Column:
    """All that is given holds. An index without file_uid is filtered by the files' names instead."""
    parts = []
    if wanted := real(file_uids):
        parts.append(F.col("file_uid").isin(*wanted) if "file_uid" in index.columns else F.col("file_name").isin(*file_names))
    if file_type:
        parts.append(F.col("file_type") == file_type)
    if content_type:
        parts.append(F.col("content_type") == content_type)
    if chunk:
        parts.append(F.col("chunk_type") == chunk)
    if tags:
        parts.append(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def known_files(files: DataFrame, ids: list[str]) -> list[str]:
    """uids of the files with these ids; some unknown ids narrow the search, only unknown ones are an error."""
    if not ids:
        return []
    found = [r[0] for r in files.where(F.col("id").isin(*ids)).select("uid").orderBy("uid").collect()]  # no more than were asked for
    if not found:
        raise NotFound(f"no file of {ids}")
    return found


#: Kinds of chunks that a search can be narrowed to.
CHUNK_TYPES = ("TYPE_CONTENT", "TYPE_SUMMARY", "TYPE_AUGMENTED")
UNSPECIFIED = ("", "TYPE_UNSPECIFIED", "FILE_MEDIA_TYPE_UNSPECIFIED")


class Unsupported(ValueError):
    pass


def media_type(media: str | None) -> str | None:
    """The content type that a search is narrowed to: documents or, unspecified, any; all other media are errors."""
    if (media or "") in UNSPECIFIED:
        return None
    if media in ("TYPE_DOCUMENT", "FILE_MEDIA_TYPE_DOCUMENT"):
        return "document"
    raise Unsupported(f"unsupported file type: {media}")


def chunk_type(kind: str | None) -> str | None:
    """The kind of chunks that a search is narrowed to; unspecified: any; all other kinds are errors."""
    if (kind or "") in UNSPECIFIED:
        return None
    if kind in CHUNK_TYPES:
        return kind
    raise Unsupported(f"unsupported chunk type: {kind}")


def hydrated(hits: DataFrame, chunks: DataFrame, files: DataFrame, blobs: DataFrame, namespace: str, kb: str) -> DataFrame:
    """One row for each hit that can be shown: its place, chunk, file and text.

    hits: source_uid, source_table, score. Only hits of chunks count; a chunk that is gone, isn't retrievable, or whose
    file or blob is missing is skipped after the ranking, so that there may be fewer rows than were asked for. The
    hits are few, so the large tables are filtered by them.
    """
    own = hits.where(F.col("source_table") == "chunk").select(F.col("source_uid").alias("uid"), "score")
    rows = chunks.where("retrievable").join(own, "uid").join(files.where("delete_time is null").select(F.col("uid").alias("file_uid"), F.col("id").alias("file_id")), "file_uid")
    return rows.join(blobs.select(F.col("uid"), F.col("content").alias("body")), "uid").where(F.col("body").isNotNull()).select("score", "body", *projected(namespace, kb))


def projected(namespace: str, kb: str) -> list[Column]:
    """What is told of a chunk: names, type, and the places in the text and in the original."""
    base = F.concat(F.lit(f"namespaces/{namespace}/knowledge-bases/{kb}/files/"), F.col("file_id"))
    kind = F.when(F.col("chunk_type").isin("TYPE_CONTENT", "TYPE_SUMMARY", "TYPE_AUGMENTED"), F.col("chunk_type")).otherwise("TYPE_CONTENT")
    return [
        F.concat(base, F.lit("/chunks/"), F.col("uid")).alias("name"), F.col("uid").alias("id"), base.alias("original_file"), kind.alias("type"), F.col("tokens"),
        F.struct(F.lit("CHARACTER").alias("unit"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).alias("markdown_reference"),
        reference(F.col("from_ms"), F.col("to_ms"), F.col("page"), F.col("last_page")).alias("reference"), F.lit("RANKER_RRF").alias("ranker"),
    ]


def bodies(chunks: DataFrame, blobs: DataFrame, file_uid: str) -> DataFrame:
    """A file's chunks with their texts; unlike a search, one missing blob is an error."""
    own = chunks.where(F.col("file_uid") == file_uid).join(blobs.select("uid", F.col("content").alias("body")), "uid", "left")
    if not (bad := own.where(F.col("body").isNull())).isEmpty():
        raise NotFound(f"no blob of {bad.first()['uid']}")
    return own
