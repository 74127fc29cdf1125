"""Operator 2, language ID by Bayesian evidence fusion.

Four kinds of evidence are combined for every page: the likelihood of its visible text
under hashed character trigrams of each language, the language its markup declares, the
language its address suggests (a path part such as ``/en/``, a host part or a country
suffix), and a prior of its host.

* The text model is fitted on a bounded sample of labelled documents (``TRAIN_ROWS`` in the
  order of a hash of doc_id, texts up to ``TRAIN_CHARS``).  Trigrams of a text depend on
  each other, so its log likelihood counts as that of a number of trigrams at most.  That number is
  fitted: of ``WEIGHTS`` the one with the least log loss on ``HELD_OUT`` of the sample, in
  pieces from a line to the whole text, under a model of the rest.
* How far markup and address are to be trusted is not assumed: for each language the share
  of pages that declare it is a grouped sum of the text posteriors, smoothed.
* Host priors are grouped sums of text posteriors, smoothed towards the domain, which is
  smoothed towards all pages (``SMOOTH`` pages each).  A page's own part is taken out.

Sums are combined before the shuffle, so a host with a third of all pages is no hot task;
page texts are read once and not shuffled.

Defined results: null or empty html gives no text evidence, and the other evidence decides;
a null url is a host of its own; without any labelled document every page has a null
language; repeated pages count as pages; very long pages are read whole; an empty table gives an empty result; further
columns, of whatever names, are ignored.  Ties go to the language that sorts first.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, shared_table

TRAIN_ROWS = 4000
TRAIN_CHARS = 20_000
CELLS = 1 << 16
WEIGHTS = (10, 30, 100, 300, 1000, 3000)
#: every so many rows of the sample one is held out for the fit of the weight, and the pieces' characters
HELD_OUT = 4
PIECES = (60, 400, TRAIN_CHARS)
SMOOTH = 10.0
TRUST = 2.0
#: country suffixes of the web that suggest a language (fixed values)
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}

_NOT_TEXT = re.compile(r"<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]+)|content-language[\"']?\s+content\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)


def visible(source: str) -> str:
    return entities.unescape(_NOT_TEXT.sub(" ", source))


def trigram_cells(text: str) -> np.ndarray:
    """Cell of each byte trigram of the lower-cased text; white space and ASCII signs are one space."""
    data = LOWER[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    data = np.where((data >= 128) | ((data >= 97) & (data <= 122)), data, 32).astype(np.int64)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    data = data[keep]
    return ((data[:-2] * 65_599 + data[1:-1]) * 65_599 + data[2:]) % CELLS if len(data) > 2 else np.zeros(0, np.int64)


class TextModel:
    def __init__(self, texts: list[str], langs: list[str], weight: int = WEIGHTS[1]):
        self.weight = weight
        self.langs = sorted(set(langs))
        counts = np.full((max(1, len(self.langs)), CELLS), 0.5)
        for text, lang in zip(texts, langs, strict=True):
            cells = trigram_cells(text)
            if len(cells):
                counts[self.langs.index(lang)] += np.bincount(cells, minlength=CELLS) / len(cells) * min(len(cells), 2000)
        self.table = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)

    def likelihoods(self, text: str) -> np.ndarray:
        return self._weighted(*self._sums(text), self.weight)

    def _sums(self, text: str) -> tuple[np.ndarray, int]:
        cells = trigram_cells(text)
        return self.table[:, cells].sum(1, dtype=np.float64) if len(cells) else np.zeros(len(self.langs)), len(cells)

    @staticmethod
    def _weighted(total: np.ndarray, cells: int, weight: int) -> np.ndarray:
        total = total * min(1.0, weight / max(1, cells))
        return total - (total.max() if len(total) else 0.0)

    def best_weight(self, texts: list[str], langs: list[str]) -> int:
        """The weight of least log loss on labelled texts (the smaller of equals)."""
        seen = [(self._sums(t[:n]), self.langs.index(k)) for t, k in zip(texts, langs, strict=True) if k in self.langs for n in PIECES]

        def loss(weight: int) -> float:
            out = 0.0
            for (total, cells), k in seen:
                x = self._weighted(total, cells, weight)
                out += np.log(np.exp(x).sum()) - x[k]
            return round(out, 9)
        return min(WEIGHTS, key=lambda w: (loss(w), w)) if seen else self.weight


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> TextModel:
    """The sample's ids are drawn first (at most ``rows``, so they can be broadcast), then their texts are read."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    ids = usable.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("turn")).distinct().orderBy("turn").limit(rows)
    sample = (usable.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
              .groupBy("doc_id", "turn").agg(F.min(F.struct("text", "lang")).alias("row")).orderBy("turn").select("row.*").collect())
    texts, langs = [r["text"] for r in sample], [r["lang"] for r in sample]
    held = slice(0, None, HELD_OUT)
    rest = [[x for i, x in enumerate(side) if i % HELD_OUT] for side in (texts, langs)]
    return TextModel(texts, langs, TextModel(*rest).best_weight(texts[held], langs[held]))


def address(url: str | None) -> tuple[str, str, str | None]:
    """Host, domain (its last two parts) and the language code that the address suggests."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*(?:/([^/?#]*))?", url or "")
    host = m[1].lower() if m else ""
    parts = host.split(".")
    path = re.match(r"([a-z]{2})(?:[-_][a-z]{2})?$", (m[2] or "").lower()) if m else None
    code = path[1] if path else parts[0] if len(parts) > 2 and len(parts[0]) == 2 else SUFFIXES.get(parts[-1])
    return host, ".".join(parts[-2:]), code


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, declared, suggested and log likelihoods of every page (written)."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rows = []
            for page, url, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                source = source or ""
                m = _DECLARED.search(source)
                declared = (m[1] or m[2]).lower() if m else "none"
                host, domain, code = address(url)
                known = lambda c: c if c in model.langs else "other"
                rows.append((page, host, domain, known(declared) if m else "none", known(code) if code else "none", model.likelihoods(visible(source)).tolist()))
            names = ["page_id", "host", "domain", "declared", "suggested", "text"]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return shared_table(pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, host string, domain string, declared string, suggested string, text array<double>"), "evidence")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, suggested, lang and confidence of every page."""
    model = fit(docs)
    langs = model.langs
    if not langs:
        return evidence(pages, TextModel([], [])).select("page_id", "host", "declared", "suggested", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    rows = evidence(pages, model)
    total = sum((F.exp(F.get("text", k)) for k in range(1, len(langs))), F.exp(F.get("text", 0)))
    rows = rows.select("*", *[(F.exp(F.get("text", k)) / total).alias(f"p{k}") for k in range(len(langs))])
    mass = [F.sum(f"p{k}").alias(f"m{k}") for k in range(len(langs))]
    # at most (languages + 2) ** 2 rows come back: how markup and address go with the text
    kinds = rows.groupBy("declared", "suggested").agg(*mass).collect()
    every = [sum(r[f"m{k}"] for r in kinds) for k in range(len(langs))]
    values = [*langs, "other", "none"]

    def reliability(column: str):
        """log P(value | language), as one column per language."""
        out = []
        for k, lang in enumerate(langs):
            score = F.lit(0.0)
            for v in values:
                seen = sum(r[f"m{k}"] for r in kinds if r[column] == v)
                share = (seen + TRUST * (v == lang) + 0.1) / (every[k] + TRUST + 0.1 * len(values))
                score = F.when(F.col(column) == v, float(np.log(share))).otherwise(score)
            out.append(score)
        return out

    hosts = rows.groupBy("domain", "host").agg(*mass)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"m{k}").alias(f"d{k}") for k in range(len(langs))])
    fused = rows.join(hosts.join(domains, "domain"), ["domain", "host"])
    whole = sum(every)
    score = []
    size = lambda c: sum((F.col(f"{c}{k}") for k in range(1, len(langs))), F.col(f"{c}0"))
    markup, place = reliability("declared"), reliability("suggested")
    for k in range(len(langs)):
        base = (every[k] + 1.0) / (whole + len(langs))
        domain = (F.greatest(F.lit(0.0), F.col(f"d{k}") - F.col(f"p{k}")) + SMOOTH * base) / (F.greatest(F.lit(0.0), size("d") - 1) + SMOOTH)
        host = (F.greatest(F.lit(0.0), F.col(f"m{k}") - F.col(f"p{k}")) + SMOOTH * domain) / (F.greatest(F.lit(0.0), size("m") - 1) + SMOOTH)
        score.append(F.get("text", k) + markup[k] + place[k] + F.log(host))
    fused = fused.select("page_id", "host", "declared", "suggested", *[s.alias(f"s{k}") for k, s in enumerate(score)])
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(langs))]) if len(langs) > 1 else F.col("s0")
    lang = F.coalesce(*[F.when(F.col(f"s{k}") == top, F.lit(name)) for k, name in enumerate(langs)])
    weight = sum((F.exp(F.col(f"s{k}") - top) for k in range(1, len(langs))), F.exp(F.col("s0") - top))
    return fused.select("page_id", "host", "declared", "suggested", lang.alias("lang"), F.round(1 / weight, 6).alias("confidence"))
