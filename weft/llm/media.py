"""Media columns: documents as interleaved sequences of text and media.

An HTML page becomes an ordered array of items; an item is a piece of text or a reference to a media object by the
SHA-256 digest of its stored bytes, with its position and caption. Payloads live in their own table, one row per
digest, and a join by digest resolves the references, so a payload that many documents show is kept once.

Stored form: binary PGM (``P5``), one 8-bit grey sample per payload byte, 24 samples a row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, from_text

#: Payloads are padded with this byte value to a positive multiple of TILE bytes (24 rows of 24 samples).
PAD, WIDTH, TILE = 255, 24, 576

ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,n_bytes:long,caption:string>>"
FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: Column) -> Column:
    """Binary ``data`` followed by bytes PAD up to a positive multiple of TILE; null counts as empty."""
    data = F.coalesce(data, F.lit(b""))
    n = F.octet_length(data)
    fill = F.when(n == 0, TILE).otherwise(F.pmod(-n, F.lit(TILE)))
    return F.concat(data, F.unhex(F.repeat(F.lit(f"{PAD:02X}"), fill.cast("int"))))


def stored(payload: Column) -> Column:
    """The PGM file that holds a padded payload, byte for byte."""
    rows = (F.octet_length(payload) / WIDTH).cast("long").cast("string")
    return F.concat(F.concat(F.lit(f"P5\n{WIDTH} "), rows, F.lit("\n255\n")).cast("binary"), payload)


def samples(media: bytes) -> np.ndarray:
    """The 8-bit samples of a PGM file as written by :func:`stored`, one row of the array per row of the picture."""
    magic, size, depth, rest = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(rest) != width * height:
        raise ValueError("not an 8-bit PGM file")
    return np.frombuffer(rest, np.uint8).reshape(height, width)


def feature_of(picture: np.ndarray) -> str:
    """Mean, spread, entropy of the sample values and mean step between neighbouring samples, as text."""
    counts = np.bincount(picture.ravel(), minlength=256)
    p = counts[counts > 0] / picture.size
    step = np.abs(np.diff(picture.astype(np.int16), axis=1)).mean()
    return f"mean={picture.mean():.4f};std={picture.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};step={step:.4f}"


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for digest, media in zip(b["digest"], b["media"], strict=True):
            if media is None:
                continue
            picture = samples(media)
            payload = picture.tobytes()
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(picture)))
        yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_facts(media: DataFrame) -> DataFrame:
    """Read stored media back and compute features: one row per digest.

    media: (digest, media binary). Rows without media are ignored; other columns are not used. Reading happens where the
    bytes lie; only the short facts are shuffled, and repeated digests are folded before the shuffle.
    """
    facts = media.select("digest", "media").mapInPandas(_facts, FACTS)
    names = [c for c in facts.columns if c != "digest"]
    return facts.groupBy("digest").agg(F.min(F.struct(*names)).alias("f")).select("digest", "f.*")


class _Items(HTMLParser):
    """Collects text and media references in document order."""

    SKIPPED = frozenset({"script", "style", "template"})
    BREAKS = frozenset({"p", "div", "figure", "figcaption", "section", "article", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "blockquote", "pre"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.waiting: list[int] = []
        self.skip = 0

    def flush(self) -> None:
        text = "".join(self.text).strip()
        if text:
            self.items.append([len(self.items), "text", text, None, None, None])
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIPPED:
            self.skip += 1
        if tag in self.BREAKS or tag == "img":
            self.flush()
        if tag == "figure":
            self.waiting = []
        elif tag == "figcaption":
            self.caption = []
        elif tag == "img":
            a = dict(attrs)
            src, n = a.get("src") or "", a.get("data-bytes") or ""
            digest = src.removeprefix("sha256:").lower() if src.startswith("sha256:") else None
            self.waiting.append(len(self.items))
            self.items.append([len(self.items), "media", None, digest, int(n) if n.isdigit() else None, a.get("alt")])

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for k in self.waiting:
                self.items[k][5] = said
            self.caption = None
        elif tag in self.BREAKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def items_of(html: str | None) -> list[tuple]:
    """The ordered items of one page; a null or empty page has none. A caption belongs to the media of its figure."""
    p = _Items()
    p.feed(html or "")
    p.close()
    p.flush()
    return [tuple(x) for x in p.items]


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, items): every page as its ordered items. One narrow pass; no other column of ``pages`` is used."""
    kind = dict(pages.dtypes)[key]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "items": [items_of(h) for h in b["html"]]})

    return pages.select(as_text(key).alias("key"), F.col(html).alias("html")).mapInPandas(parse, f"key string, items {ITEMS}").select(from_text("key", kind, key), "items")


def references(seqs: DataFrame, key: str) -> DataFrame:
    """One row per media reference: key, position, digest, n_bytes, caption."""
    return seqs.select(key, F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("r")).select(key, "r.position", "r.digest", "r.n_bytes", "r.caption")


def resolved(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """References with the facts of their media; a reference whose digest is not stored keeps nulls there.

    Both sides are short rows. A digest that many documents cite makes the reference side uneven: the join asks for its
    own exchange on both sides (the salt is a constant of the digest), so adaptive execution can split that side.
    """
    same = F.substring("digest", 1, 2)
    left, right = refs.withColumn("_lead", same), facts.withColumn("_lead", same)
    return left.join(right, ["digest", "_lead"], "left").drop("_lead")


def document_payloads(docs: DataFrame) -> DataFrame:
    """For documents (doc_id, text): n_bytes, stored media, its digest, and a page that shows the text and its media.

    Null text is empty text. The page has the text as paragraph and a figure with a caption.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    data = text.cast("binary")
    d = docs.select("doc_id", text.alias("text"), F.octet_length(data).cast("long").alias("n_bytes"), stored(padded(data)).alias("media"))
    d = d.withColumn("digest", F.sha2("media", 256))
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<p>"), safe, F.lit('</p><figure><img src="sha256:'), F.col("digest"), F.lit('" data-bytes="'), F.col("n_bytes").cast("string"), F.lit('"><figcaption>payload of '), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure>"))
    return d.withColumn("html", page)


def document_media(docs: DataFrame) -> DataFrame:
    """Every document's payload stored, cited from its page, resolved by digest and described; one row per document.

    A null text is empty. Equal texts have one payload and equal values; an empty table gives no rows; columns other than
    doc_id and text are not read.
    """
    d = document_payloads(docs)
    refs = references(sequences(d.select("doc_id", "html"), "doc_id"), "doc_id")
    out = resolved(refs, media_facts(d.select("digest", "media")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
