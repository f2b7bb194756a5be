"""Interleaved document sequences with media columns.

HTML is parsed into an ordered array of items: texts, and media references that carry a digest and a
caption. Media are stored once for each digest, the SHA-256 of their payload, in a table of their own;
digest joins resolve references, and each item keeps its position and caption.

Storing takes two passes: the first writes each row's digest, the second the media. A payload whose
digest only one row has is written where it is read; only those that several rows share are shuffled,
one a task and digest, to be written once.

A payload is stored losslessly as a binary pixmap (P6): 64 pixels a row of three 8-bit samples, so a row
is 192 bytes and a payload of a multiple of 192 bytes fills the picture.

Defined cases: null and empty texts have a payload of 192 spaces; equal texts share digest and values;
a reference without a stored payload stays in its place with nulls; rows that repeat are kept, with null
ids too; other columns aren't carried along, but for those that ``sequences`` is told to keep; unclosed
tags end with the page, null pages have no items; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import html as references
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import documents, materialize, with_rows, without_ids

ROW = 192  # bytes
SCHEME = "sha256:"
OWN = "own payload"
ITEMS = "array<struct<position:int,text:string,digest:string,caption:string>>"
_ITEM = re.compile(
    r"<figure\b[^>]*>(?P<figure>.*?)(?:</figure\s*>|\Z)|(?P<img><(?:img|video|audio|source)\b[^>]*>)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)|<!--.*?(?:-->|\Z)|(?P<tag><[^>]*>)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_SOURCE = re.compile(rf"<(?:img|video|audio|source)\b[^>]*?\bsrc\s*=\s*[\"']?{SCHEME}([0-9a-f]{{64}})", re.I)
_ALT = re.compile(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CAPTION = re.compile(r"<figcaption\b[^>]*>(.*?)(?:</figcaption\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|h[1-6]|li|ul|ol|article|section|table|tr|blockquote|body|html)\b", re.I)


def _plain(markup: str) -> str:
    return " ".join(references.unescape(re.sub(r"<[^>]*>", "", markup)).split())


def parse(page: str) -> list[dict]:
    """Ordered items of a page: texts of its blocks and its media references with captions."""
    items: list[dict] = []
    held: list[str] = []

    def close() -> None:
        if text := " ".join(references.unescape("".join(held)).split()):
            items.append({"position": len(items), "text": text, "digest": None, "caption": None})
        held.clear()

    for m in _ITEM.finditer(page):
        if m["text"] is not None:
            held.append(m["text"])
        elif m["tag"]:
            if _BLOCK.match(m["tag"]):
                close()
        elif m["figure"] is not None or m["img"]:
            close()
            markup = m["figure"] if m["figure"] is not None else m["img"]
            caption = _CAPTION.search(markup)
            caption = _plain(caption[1]) if caption else references.unescape(alt[1] or alt[2] or alt[3] or "") if (alt := _ALT.search(markup)) else None
            for digest in _SOURCE.findall(markup):
                items.append({"position": len(items), "text": None, "digest": digest.lower(), "caption": caption})
    close()
    return items


def sequences(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, and items of every row of doc_id and HTML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = pa.list_(pa.struct([("position", pa.int32()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([parse(h or "") for h in batch.column(1).to_pylist()], kind)], ["doc_id", *keep, "items"])

    kinds = "".join(f"`{c}` {kind}, " for c in keep for name, kind in df.dtypes if name == c)
    return df.select("doc_id", html, *keep).mapInArrow(run, f"doc_id long, {kinds}items {ITEMS}")


def references_of(items: DataFrame) -> DataFrame:
    """doc_id, kept columns, position, caption and digest of every media reference."""
    kept = [c for c in items.columns if c != "items"]
    rows = items.select(*kept, F.explode("items").alias("i")).filter("i.digest is not null")
    return rows.select(*kept, "i.position", "i.caption", "i.digest")


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """doc_id and every reference with the media table's columns: a digest join, large digests split by adaptive execution."""
    return references_of(items).join(media, "digest", "left")


def payload(text: Column) -> Column:
    """UTF-8 of a text, filled with spaces up to a positive multiple of a row."""
    raw = F.encode(text, "UTF-8")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(ROW))).cast("int") * ROW
    return F.rpad(raw, size, F.lit(b" "))


def pixmap(samples: Column) -> Column:
    """A binary pixmap of the samples."""
    rows = (F.octet_length(samples) / F.lit(ROW)).cast("int").cast("string")
    return F.concat(F.encode(F.concat(F.lit("P6\n64 "), rows, F.lit("\n255\n")), "UTF-8"), samples)


def samples_of(media: bytes) -> bytes:
    """The samples of a binary pixmap; raises ValueError if it is none, or cut short."""
    head = re.match(rb"P6\s(\d+)\s(\d+)\s255\s", media)
    if not head or len(media) - head.end() != 3 * int(head[1]) * int(head[2]):
        raise ValueError("not a whole pixmap")
    return media[head.end() :]


def feature(samples: bytes) -> str:
    """Average hash over 64 stretches of grey values, and their mean and spread."""
    grey = np.frombuffer(samples, np.uint8).reshape(-1, 3).sum(axis=1, dtype=np.int64)
    cuts = np.arange(64) * len(grey) // 64
    means = np.add.reduceat(grey, cuts) / np.diff(np.append(cuts, len(grey)))
    bits = np.packbits(means > grey.mean()).tobytes().hex()
    return f"{bits}:{grey.mean() / 3:.4f}:{grey.std() / 3:.4f}"


def store(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: doc_id, n_bytes and digest of every row, and digest and pixmap of every payload, once each."""
    found = documents(df).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), payload(F.col("text")).alias("p"))
    found = found.select("doc_id", "n_bytes", F.sha2("p", 256).alias("digest"), "p")
    rows = materialize(found.select("doc_id", "n_bytes", "digest"), "payload-digests")
    key = F.xxhash64("digest").alias("_silt_key")
    shared = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_silt_key"), "shared-digests")
    media = found.select(key, "digest", pixmap(F.col("p")).alias("media"))
    once = without_ids(media, shared, "_silt_key").select("digest", "media")
    several = with_rows(media, shared, "_silt_key").select("digest", "media").dropDuplicates(["digest"])
    return rows, materialize(once.unionAll(several), "media")


def pages(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, n_bytes, digest) with an HTML page each: text, its figure, text, and the same media once more."""
    reference = F.concat(F.lit(f'src="{SCHEME}'), "digest", F.lit('"'))
    name = F.concat(F.lit("Document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    parts = ["<article><h1>", name, "</h1><figure><img ", reference, "><figcaption>", OWN, "</figcaption></figure><p>It has ", F.col("n_bytes").cast("string"), ' bytes.</p><img alt="again" ', reference, "><p>End</p></article>"]
    return rows.withColumn("html", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))


def media_features(media: DataFrame) -> DataFrame:
    """For each row of digest and media: payload and media sizes and digests, tail checksum and feature, from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = blob.as_py()
                p = samples_of(media)
                found = hashlib.sha256(p).hexdigest()
                if found != digest:
                    raise ValueError(f"payload {digest} reads back as {found}")
                rows.append((digest, len(p), found, zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("digest", "media").mapInArrow(run, schema)
