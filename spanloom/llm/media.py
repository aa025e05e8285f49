"""Media columns: interleaved document sequences.

A page's HTML is parsed into an ordered array of structs, either a piece of text or a
reference to a medium by content digest with its caption; positions count from zero
over both. Media lie in a store keyed by digest, once per content. A join on the digest
resolves references to what the store holds, and the resolved structs return to their
places, so positions and captions stay aligned.

Stored media are 8-bit greyscale PNG images, 64 samples a row and one per payload byte:
a lossless form of any byte payload that is a positive multiple of 64 long. Features
come from the samples read back, not from the text.

A null text or page counts as empty: its payload is 64 zero bytes, its sequence is
empty. References without a medium keep their place with null features. Equal texts
share one medium. Repeated rows, null ids and extra columns are kept apart from the
digests; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ids_of, shared_table, small_batches, texts_of

ROW = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The text's bytes, filled with zeros to a positive multiple of 64."""
    return text + bytes(-len(text) % ROW if text else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> np.ndarray:
    """Samples (rows, 64) of a stored image; chunk checksums are verified."""
    if png[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, head = 8, b"", b""
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    width, height = struct.unpack_from(">II", head)
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are stored")
    return lines[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, standard deviation, mean step between neighbours and an eight-bin histogram, all as whole numbers."""
    flat = samples.reshape(-1)
    total, squares = int(flat.sum(dtype=np.int64)), int((flat.astype(np.int64) ** 2).sum())
    n = len(flat)
    step = int(np.abs(np.diff(flat.astype(np.int16))).sum(dtype=np.int64))
    hist = np.bincount(flat >> 5, minlength=8).tolist()
    return f"rows={len(samples)};mean={1000 * total // n};var={1000 * (n * squares - total * total) // (n * n)};step={1000 * step // n};hist={'/'.join(map(str, hist))}"


# --- interleaved sequences -----------------------------------------------------------

PIECE = "struct<pos: int, kind: string, text: string, digest: string, caption: string, n_bytes: bigint>"
_PIECE_TYPE = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())]))
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|([^<]++|<)", re.S)
_ATTR = re.compile(r"""([a-z-]+)=(?:"([^"]*)"|'([^']*)')""")
_BREAK = frozenset("p div figure figcaption article section h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre img".split())


def parse(page: str | None) -> list[dict]:
    """Ordered pieces of a page: text blocks, and media references with the caption of their figure."""
    out: list[dict] = []
    held: list[str] = []
    figure, captioned = -1, False

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if not text:
            return
        if captioned and figure >= 0:
            for piece in out[figure:]:
                if piece["kind"] == "media":
                    piece["caption"] = f"{piece['caption']} {text}" if piece["caption"] else text
        else:
            out.append({"pos": len(out), "kind": "text", "text": text, "digest": None, "caption": None, "n_bytes": None})

    for m in _TOKEN.finditer(page or ""):
        if m[4] is not None:
            held.append(m[4])
            continue
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _BREAK:
            flush()
        if tag == "figure":
            figure = -1 if closing else len(out)
        elif tag == "figcaption":
            captioned = not closing
        elif tag == "img" and not closing:
            attr = {k: html.unescape(a or b) for k, a, b in _ATTR.findall(m[3])}
            src = attr.get("src", "")
            n = attr.get("data-bytes", "")
            out.append({"pos": len(out), "kind": "media", "text": None, "digest": src[7:] if src.startswith("sha256:") else None, "caption": attr.get("alt") or None, "n_bytes": int(n) if n.isdigit() else None})
    flush()
    return out


def sequences(pages: DataFrame, key: str) -> DataFrame:
    """(key, seq): the interleaved sequence of every page's html."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(x) for x in b.column(1).to_pylist()], _PIECE_TYPE)], [key, "seq"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInArrow(run, f"{key} {kind}, seq array<{PIECE}>")


def store(docs: DataFrame) -> DataFrame:
    """(digest, media): the media store, written as a table that all executors share.

    Copies met by one task are stored once; resolving removes what copies are left.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keys, media = [], []
            for t in texts_of(b):
                p = payload_of(t)
                d = hashlib.sha256(p)
                if d.digest() not in seen:
                    seen.add(d.digest())
                    keys.append(d.hexdigest())
                    media.append(to_png(p))
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return shared_table(docs.select("text").mapInArrow(run, "digest string, media binary"))


READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, one row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            rows = []
            for d, png in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                samples = from_png(png)
                p = samples.tobytes()
                rows.append((d, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ROW:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(samples)))
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for c, n in zip(cols, names)], names)

    return media.mapInArrow(run, READ).dropDuplicates(["digest"])


def resolve(seqs: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """``seqs`` with one row per media reference, its place and caption, and what the store holds for it."""
    refs = seqs.select(key, F.explode("seq").alias("piece")).where("piece.kind = 'media'").select(key, "piece.pos", "piece.caption", "piece.n_bytes", "piece.digest")
    return refs.join(media, "digest", "left")


def interleave(seqs: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """``seqs`` with the resolved medium of every piece, in place; ``key`` must be unique."""
    got = resolve(seqs, media, key).select(key, "pos", F.struct(*[c for c in media.columns if c != "digest"]).alias("medium"))
    each = seqs.select(key, F.posexplode_outer("seq").alias("i", "piece"))
    joined = each.join(got.withColumnRenamed("pos", "i"), [key, "i"], "left")
    return joined.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "piece", "medium")))).alias("seq"))


def figure_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, html): a page per document that shows its text's medium by reference."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = ids_of(b), []
            for i, t in zip(ids, texts_of(b)):
                d = hashlib.sha256(payload_of(t)).hexdigest()
                out.append(f'<article><p>Document {i}</p><figure><img src="sha256:{d}" data-bytes="{len(t)}"><figcaption>Text of document {i}</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "html"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, html string")


def document_media(docs: DataFrame) -> DataFrame:
    """Media columns of every document."""
    # Cut here so that the join deals both sides anew: a medium that very many documents
    # show is then a skewed key that Spark can split.
    media = cut(read_back(store(docs)))
    out = resolve(sequences(figure_pages(docs), "doc_id"), media, "doc_id")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("pos").alias("position"), "caption")
