"""Media columns: interleaved sequences of text and media, with payloads resolved by digest.

Parsing a page gives its texts and media references in order, as one array of structs in
which positions, references and captions stay together. Payloads live in a table of their
own, keyed by the digest that references name. References leave their pages, a row each, a
join brings in what is read back of their payloads, and they return to their positions.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Node, blocks
from .shared import dropped, pick, written
from .words import buffers, frugal

ROW = 64
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("chars", pa.int64()), ("digest", pa.string()), ("caption", pa.string())])
ITEM_TYPE = "array<struct<position int, kind string, text string, chars long, digest string, caption string>>"
FIELDS = ("position", "kind", "text", "chars", "digest", "caption")
SCHEME = "sha256:"


def sequence(page: str) -> list[dict]:
    """The items of a page in order: texts, and media with their digests and captions. The
    caption is the figcaption of the figure around, else the alternative text; a source that
    isn't a digest gives an item with a null digest and the source as its text."""
    nodes = blocks(page, media=True)

    def around(i: int, tag: str) -> int:
        while i > 0 and nodes[i].tag != tag:
            i = nodes[i].parent
        return i

    captions: dict[int, list[str]] = {}
    pictured = {f for i, x in enumerate(nodes) if x.media and (f := around(i, "figure")) > 0}
    inside = {}
    for i, x in enumerate(nodes):
        if x.tag == "#text" and x.text and around(i, "figcaption") > 0 and (f := around(i, "figure")) in pictured:
            captions.setdefault(f, []).append(x.text)
            inside[i] = f
    out: list[dict] = []

    def add(kind: str, text: str | None, digest: str | None = None, caption: str | None = None) -> None:
        out.append({"position": len(out), "kind": kind, "text": text, "chars": len(text) if kind == "text" else None, "digest": digest, "caption": caption})

    def show(x: Node, i: int, source: str, alt: str) -> None:
        caption = " ".join(captions.get(around(i, "figure"), ())) or alt or None
        digest = source[len(SCHEME) :] if source.startswith(SCHEME) else None
        add("media", None if digest else source, digest, caption)

    for i, x in enumerate(nodes):
        if x.tag != "#text":
            continue
        at = 0
        for place, source, alt in x.media:
            if i not in inside and x.text[at:place].strip():
                add("text", x.text[at:place].strip())
            at = place
            show(x, i, source, alt)
        if i not in inside and x.text[at:].strip():
            add("text", x.text[at:].strip())
    return out


def png(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as an 8-bit grey image, 64 samples wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    packed = zlib.compress(raw, 6)
    data = b"".join(chunk(b"IDAT", packed[i : i + (1 << 30)]) for i in range(0, len(packed), 1 << 30))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + data + chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of an image that png() made, row by row; checks sums and shape."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, packed, width, height = 8, [], 0, 0
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        name, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(name + body):
            raise ValueError("a damaged chunk")
        if name == b"IHDR":
            width, height, bits, color, *_ = struct.unpack(">IIBBBBB", body)
            if (bits, color) != (8, 0):
                raise ValueError("not an 8-bit grey image")
        elif name == b"IDAT":
            packed.append(body)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter that png() doesn't use")
    return rows[:, 1:]


def feature(rows: np.ndarray) -> str:
    """Height, mean, deviation, mean step between neighbours, and a histogram of 8 bins."""
    x = rows.ravel()
    n = len(x)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    mean = total / n
    steps = np.abs(np.diff(rows.astype(np.int16), axis=1)).sum(dtype=np.int64) / (rows.shape[0] * (rows.shape[1] - 1))
    bins = ",".join(map(str, np.bincount(x >> 5, minlength=8)))
    return f"rows={rows.shape[0]};mean={mean:.6f};sd={max(squares / n - mean * mean, 0) ** 0.5:.6f};step={steps:.6f};hist={bins}"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def _texts(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows a:b of a batch and their texts, about ``size`` bytes at a time."""
    data, at = buffers(batch.column(0))
    whole = data.tobytes()
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield a, b, [whole[at[i] : at[i + 1]] for i in range(a, b)]
        a = b


def _media(raw: bytes) -> list[bytes]:
    """The payloads that a text's page shows: all of it, and its last 64 bytes."""
    payload = padded(raw)
    return [payload, payload[-ROW:]]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Images of the payloads, keyed by their digests, each once in a task."""
    seen: set[bytes] = set()
    for batch in batches:
        for _, _, texts in _texts(batch):
            out = {}
            for payload in (x for raw in texts for x in _media(raw)):
                key = hashlib.sha256(payload)
                if key.digest() not in seen:
                    seen.add(key.digest())
                    out[key.hexdigest()] = png(payload)
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.binary())], names=["digest", "media"])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as pages: a paragraph for each line, the picture of the whole text half way, and
    that of its end below."""

    def figure(payload: bytes, caption: str) -> str:
        return f'<figure><img src="{SCHEME}{hashlib.sha256(payload).hexdigest()}" alt="text"><figcaption>{caption}</figcaption></figure>'

    for batch in batches:
        for a, b, texts in _texts(batch):
            pages = []
            for raw in texts:
                lines = [f"<p>{html.escape(x)}</p>" for x in raw.decode().split("\n")]
                whole, end = _media(raw)
                half = (len(lines) + 1) // 2
                pages.append("<article>" + "".join([*lines[:half], figure(whole, f"all {len(raw)} bytes"), *lines[half:], figure(end, "the last row")]) + "</article>")
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([len(x) for x in texts], pa.int64()), pa.array(pages, pa.string())], names=["doc_id", "n_bytes", "html"])


def _parse(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            pages = batch.column(0)
            while a < len(pages):
                items, size, b = [], 0, a
                while b < len(pages) and (b == a or size < 4 << 20):
                    page = pages[b].as_py() or ""
                    size += len(page)
                    found = sequence(page)
                    if not with_text:
                        found = [x | {"text": None} if x["kind"] == "text" else x for x in found]
                    items.append(found)
                    b += 1
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[1:]], pa.array(items, pa.list_(ITEM))], names=[str(i) for i in range(batch.num_columns)])
                a = b

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            image = image.as_py()
            rows = samples(image)
            payload = rows.tobytes()
            out.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), feature(rows)))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def interleaved(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id",), with_text: bool = True) -> DataFrame:
    """The columns named in ``carry`` and items: the ordered sequence of each page, whose texts
    are left out, but for their lengths, unless ``with_text``.

    Null and empty pages have no items. Rows are independent, so repeats and nulls in other
    columns change nothing; very long pages are parsed whole; an empty table gives an empty
    result; other columns are ignored."""
    named = {f"c{i}": c for i, c in enumerate(carry)}
    table = pick(pages, html=html, **named)
    types = ", ".join(f"`{c.replace('`', '``')}` {table.schema[a].dataType.simpleString()}" for a, c in named.items())
    return table.mapInArrow(frugal(_parse(with_text)), f"{types}, items {ITEM_TYPE}" if types else f"items {ITEM_TYPE}")


def resolved(references: DataFrame, store: DataFrame) -> DataFrame:
    """references: digest and any columns; store: digest and media. Joins in what reading the
    stored media back gives. Digests that the store lacks, null ones among them, get nulls.
    Stored copies of a digest are each read, and count as one: the join sees a digest once. A
    digest that a third of the references share is split by the join, both of whose sides
    are tables."""
    found = store.filter("digest IS NOT NULL").select("digest", "media").mapInArrow(frugal(_read), READ)
    return references.join(written(found.dropDuplicates(["digest"]), "media-features"), "digest", "left")


def media_columns(pages: DataFrame, store: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id",), with_text: bool = True) -> DataFrame:
    """The columns named in ``carry`` and items: the sequence of each page, as interleaved()
    gives it, with one field more, stored: what reading the item's payload back from ``store``
    (digest and media) gives; null for texts and for references that the store lacks.

    Nulls, repeats, long pages and empty tables are as in interleaved() and resolved(): each
    row has its own sequence, whatever ids it shares."""
    table = pick(pages, html=html, **{f"c{i}": c for i, c in enumerate(carry)})
    inner = tuple(f"c{i}" for i in range(len(carry)))
    made = written(interleaved(table, carry=inner, with_text=with_text).withColumn("page", F.monotonically_increasing_id()), "sequences")
    shown = made.select("page", F.inline(F.filter("items", lambda x: x["digest"].isNotNull()))).select("page", "position", "digest")
    found = resolved(shown, store).filter("payload_bytes IS NOT NULL")
    stored = F.struct(*[x.split()[0] for x in READ.split(", ")[1:]])
    found = found.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("position", stored.alias("stored")))).alias("found"))  # of one page
    joined = made.join(found, "page", "left")
    items = F.transform("items", lambda x: F.struct(*[x[f].alias(f) for f in FIELDS], F.col("found")[x["position"]].alias("stored")))
    return joined.select(*[F.col(a).alias(c) for a, c in zip(inner, carry, strict=True)], items.alias("items"))


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as a page of its lines and two pictures, and as media. The text's UTF-8, with
    bytes 0 up to a positive multiple of 64, are the samples of a lossless 8-bit grey PNG
    image in a store keyed by digest, and so are its last 64 bytes; the page's sequence refers
    to both, and a digest join resolves them.
    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, the picture's position and caption, n_items and text_chars of the
    page's sequence, and tail_sha256, the digest of the second picture's payload as read back.

    Null texts are empty ones, whose payload is 64 bytes 0. Ids are only passed on, so null
    and repeated ones get their own rows; equal texts share one digest and all values. Very
    long texts are stored whole. An empty table gives an empty result. Other columns are
    ignored.
    """
    table = pick(docs, text=text, doc_id=doc_id)
    kind = table.schema["doc_id"].dataType.simpleString()
    store = written(table.select("text").mapInArrow(frugal(_store), "digest string, media binary"), "media-store")
    pages = table.mapInArrow(frugal(_pages), f"doc_id {kind}, n_bytes long, html string")
    made = media_columns(pages, store, carry=("doc_id", "n_bytes"), with_text=False)
    dropped(store)  # what was read back of it is written
    shown = F.filter("items", lambda x: x["kind"] == "media")
    made = made.select("doc_id", "n_bytes", shown[0].alias("whole"), shown[1].alias("end"), F.size("items").alias("n_items"), F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["chars"], F.lit(0))).alias("text_chars"))
    stored = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return made.select("doc_id", "n_bytes", *[f"whole.stored.{c}" for c in stored], "whole.position", "whole.caption", "n_items", "text_chars", F.col("end.stored.payload_sha256").alias("tail_sha256"))
