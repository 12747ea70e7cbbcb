"""Evidence files: folder scan, nested archives, document table, manifest."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrain.functions import rules
from proofgrain.functions.ranking import number_repeats


def _stem_in(stem: Column, names: Sequence[str]) -> Column:
    """The stem, or one of its '__'-joined parts, is one of the names."""
    wanted = F.array(*[F.lit(n) for n in names])
    return F.arrays_overlap(F.split(stem, "__"), wanted) | stem.isin(*names)


def describe_paths(files: DataFrame, root: str = "") -> DataFrame:
    """Adds packet, name, stem and ext to rows with a ``path``.

    The packet is the first folder below ``root``; files directly in it share ''.
    """
    below = F.regexp_replace("path", rf"^(?:file:)?/*{re.escape(root.strip('/'))}/+", "")
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.withColumn("packet", F.when(below.contains("/"), F.split(below, "/")[0]).otherwise(""))
        .withColumn("name", name)
        .withColumn("stem", F.lower(F.regexp_replace("name", r"\.[^.]*$", "")))
        .withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    )


def keep_evidence(files: DataFrame, suffixes: Sequence[str] = rules.EVIDENCE_SUFFIXES) -> DataFrame:
    """Allowed suffixes without samples and dry runs; a packet that holds a PDF also drops
    its plain 'evidence' file."""
    kept = files.where(F.col("ext").isin(*suffixes)).where(
        ~(_stem_in(F.col("stem"), rules.SAMPLE_STEMS) | F.col("stem").rlike("dry[_-]run"))
    )
    with_pdf = kept.where("ext = 'pdf'").select(F.col("packet").alias("pdf_packet")).distinct()
    return kept.join(
        with_pdf,
        (F.col("packet") == F.col("pdf_packet")) & _stem_in(F.col("stem"), ("evidence",)),
        "left_anti",
    )


def scan_inbox(spark: SparkSession, path: str, skip_dirs: Sequence[str] = (), content: bool = False) -> DataFrame:
    """Recursive scan.  Contents are read only when asked for."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = raw.select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"),
        *(["content"] if content else []),
    )
    for folder in skip_dirs:
        files = files.where(~F.col("path").contains(f"/{folder}/"))
    return keep_evidence(describe_paths(files, path)).drop("stem")


# ------------------------------------------------------------------ archives
def safe_name(name: str, default: str = "member") -> str:
    parts = [p for p in re.split(r"[\\/]+", name) if p and p not in (".", "..")]
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", "__".join(parts) or default).strip("._") or default


#: Unpacked bytes that are held before they are handed on; a larger member goes by itself.
HELD = 16 << 20


def _read(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes | None:
    try:
        return archive.read(info)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
        return None  # damaged, encrypted or of an unknown compression


def _members(data: bytes, prefix: str, level: int, depth: int, suffixes: frozenset) -> Iterator[tuple[str, Callable]]:
    """(name, function that unpacks) of each member, in the order of the directories."""
    if level >= depth:
        yield f"{prefix}.zip", lambda: data
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    with archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            member = safe_name(info.filename)
            stem, _, suffix = member.rpartition(".")
            if suffix.lower() == "zip":
                yield from _members(_read(archive, info) or b"", f"{prefix}__{stem}", level + 1, depth, suffixes)
            elif suffix.lower() in suffixes:
                yield f"{prefix}__{member}", lambda info=info: _read(archive, info)


def expand_archives(
    files: DataFrame, max_depth: int = 5, suffixes: Sequence[str] = rules.EVIDENCE_SUFFIXES
) -> DataFrame:
    """Zip members as files (``packet, name, path, content``); other files pass through.

    Names come from the archives' directories alone: equal names within a packet get ``_2``,
    ``_3`` in the order of (path, place in the directory) before anything but nested archives is
    unpacked.  Then one task unpacks an archive, member by member, each once, and hands on
    ``HELD`` bytes at a time.  A bad archive and a member that can't be read yield nothing (the
    member's number stays taken).  An archive nested deeper than ``max_depth`` is kept as a
    file.  A path stands for one file of its packet.
    """
    allowed = frozenset(suffixes)

    def members(row) -> Iterator[tuple[str, Callable]]:
        if row.name.lower().endswith(".zip"):
            content = b"" if row.content is None else bytes(row.content)
            return _members(content, safe_name(row.name.rsplit(".", 1)[0], "archive"), 0, max_depth, allowed)
        return iter([(safe_name(row.name), lambda: row.content)])

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [(row.packet, name, row.path, i) for row in batch.itertuples(index=False) for i, (name, _) in enumerate(members(row))]
            yield pd.DataFrame(names, columns=["packet", "name", "path", "member"])

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows):
            return pd.DataFrame(rows, columns=["packet", "name", "path", "content"])

        held, size = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                fresh = {} if row.members is None else dict(zip(row.members, row.fresh))
                for i, (name, unpack) in enumerate(members(row)):
                    content = unpack()
                    if content is None and row.name.lower().endswith(".zip"):
                        continue
                    if held and size + len(content or b"") > HELD:
                        yield frame(held)
                        held, size = [], 0
                    held.append((row.packet, fresh.get(i, name), row.path, content))
                    size += len(content or b"")
        if held:
            yield frame(held)

    rows = files.where("name is not null").select("packet", "name", "path", "content")
    directory = rows.withColumn("content", F.when(F.lower("name").endswith(".zip"), F.col("content"))).mapInPandas(
        listed, "packet string, name string, path string, member int")
    numbered = number_repeats(directory, ["packet", "name"], ["path", "member"])
    fresh = F.concat(
        F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), F.col("n").cast("string"), F.regexp_extract("name", r"(\.[^.]*)$", 1))
    clashes = numbered.where("n > 1").groupBy("packet", "path").agg(F.collect_list(F.struct("member", fresh.alias("fresh"))).alias("x")).select(
        F.col("packet").alias("of_packet"), F.col("path").alias("of_path"), F.col("x.member").alias("members"), F.col("x.fresh").alias("fresh"))
    same = F.col("packet").eqNullSafe(F.col("of_packet")) & F.col("path").eqNullSafe(F.col("of_path"))
    return rows.join(clashes, same, "left").drop("of_packet", "of_path").mapInPandas(
        unpacked, "packet string, name string, path string, content binary")


# ------------------------------------------------------------------ documents
def build_documents(texts: DataFrame, content: str = "text") -> DataFrame:
    """One row per document: hash, method, cleaned text, size and a metadata map.

    ``texts`` has source_file, method and the content column.
    """
    from proofgrain.functions.text import clean_ocr

    cleaned = clean_ocr(F.coalesce(F.col(content), F.lit("")))
    return texts.select(
        "source_file",
        F.sha2(F.col(content).cast("binary"), 256).alias("sha256"),
        F.col("method"),
        cleaned.alias("text"),
    ).withColumn("characters", F.length("text").cast("bigint")).withColumn(
        "metadata",
        F.create_map(
            F.lit("source_file"), F.col("source_file"),
            F.lit("extension"), F.lower(F.regexp_extract("source_file", r"(\.[^.]+)$", 1)),
            F.lit("extraction_method"), F.col("method"),
            F.lit("characters"), F.col("characters").cast("string"),
        ),
    )


def file_manifest(files: DataFrame, required: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows, totals per group, required names that are missing).

    ``files`` has name, group and content (string or binary).
    """
    data = F.col("content").cast("binary")
    rows = files.select("group", "name", F.octet_length(data).cast("bigint").alias("bytes"), F.sha2(data, 256).alias("sha256"))
    totals = rows.groupBy("group").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    missing = None
    if required is not None:
        missing = required.select("name").distinct().join(rows.select("name"), "name", "left_anti")
    return rows, totals, missing
