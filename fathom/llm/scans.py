"""Traces of scanning and page layout in texts: found, and repaired into continuous paragraphs.

Running headers and footers are lines that a document repeats from page to page. Lines are compared after folding what character
recognition confuses (and standing numbers) to one form, so repetition is fuzzy without comparing lines pairwise: a line is a
header if its folded form is on at least ``header_share`` of the document's hard-wrapped pages, as scans are, or on three quarters of its other
pages, and on three of either. So a document of which only a part was scanned keeps its headers, and section titles that recur don't become
some. The counts of (document, line, page) are aggregated map-side; what comes
back to the texts is a few hashes per document, joined with AQE's skew handling, so a document with a third of all rows is no hot spot.

Page numbers are lines that only state a page in one of the usual dresses; a bare number counts only where it is the chunk's page or no
larger than the document's last page, which a year isn't.

Words broken over two lines are joined across removed lines; the corpus vocabulary decides: a hyphen stays where the
hyphenated word is known and the joined one isn't. A word is misread if one or two usual confusions turn it into a word at
least ``ratio`` times as frequent. The vocabulary holds the words with at least a share ``rare`` of all words of the corpus, so it has
at most 1/``rare`` entries whatever the corpus, of 100 characters at most, as longer words are held by a hash: that is the proven bound of its
broadcast. Words no entry of the vocabulary has nearly the length of can't be misread from one, and are not looked at.

Defined results: null and blank texts have no noise and stay as they are; rows without document have no headers; rows without
page number count as a page of their own; repeated chunks count once per page; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.vectext import batches, code_points, span_hashes, word_spans
from fathom.session import cut_lineage

# What recognition makes of a letter (or two), and the letters it stood for.
CONFUSIONS = [
    ("cl", "d"), ("rn", "m"), ("ii", "u"), ("vv", "w"), ("h", "li"), ("m", "rn"), ("c", "e"), ("5", "s"), ("@", "a"), ("!", "i"),
    ("0", "o"), ("1", "l"), ("+", "t"), ("q", "g"), ("b", "h"), ("f", "t"), ("£", "f"), ("|", "l"), ("8", "b"), ("$", "s"), ("6", "b"), ("9", "g"), ("€", "e"), ("¢", "c"),
]
HYPHENS = "-‐­¬"
PAGE = re.compile(
    r"\s*(?:(?P<bare>\d{1,4})|[\[(<{]\s*\d{1,4}\s*[\])>}]|[-–—~•·*=]+\s*\d{1,4}\s*[-–—~•·*=]+|(?:page|pg|p|seite|s|página|pág|pagina)\b\.?\s*\d{1,4}(?:\s*(?:of|/|von|sur|de)\s*\d{1,4})?|\d{1,4}\s*(?:/|of|von|sur)\s*\d{1,4})\s*\.?\s*",
    re.I,
)
DIGIT = re.compile(r"\d")
TRIM = ".,;:?!\"'()[]{}“”‘’«»„…*_"


_ONE = str.maketrans({"c": "e", "5": "s", "@": "a", "!": "i", "0": "o", "1": "l", "+": "t", "q": "g", "b": "h", "f": "t", "£": "t", "|": "l", "8": "h", "$": "s", "6": "h", "9": "g", "€": "e", "¢": "e"})
_NUMBER = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")


def fold(line: str) -> str:
    """A line as recognition can't tell it apart from its misreadings; standing numbers become one sign."""
    s = _NUMBER.sub("#", " ".join(line.lower().split()))
    s = s.translate(_ONE)
    for a, b in (("ii", "u"), ("li", "h"), ("el", "d"), ("rn", "m"), ("vv", "w")):  # c is e by now, so cl is el
        s = s.replace(a, b)
    return s


def corrections(word: str, most: int = 2) -> Iterator[str]:
    """Words that up to ``most`` confusions turn ``word`` into, fewest first."""
    seen, edge = {word}, [word]
    for _ in range(most):
        new = []
        for w in edge:
            for a, b in CONFUSIONS:
                i = w.find(a)
                while i >= 0:
                    v = w[:i] + b + w[i + len(a) :]
                    if v not in seen:
                        seen.add(v)
                        new.append(v)
                        yield v
                    i = w.find(a, i + 1)
        edge = new


def word_key(word: str) -> str:
    """Words of more than 100 characters are held by a hash."""
    return word if len(word) <= 100 else f"{len(word)}:{hashlib.blake2b(word.encode('utf-8', 'surrogatepass')).hexdigest()[:64]}"


class Words:
    """Verdicts on words against the corpus vocabulary, remembered."""

    def __init__(self, counts: dict[str, int], floor: int, ratio: float, least: int) -> None:
        self.counts, self.floor, self.ratio, self.least = counts, floor, ratio, least
        self.known: dict[str, str | None] = {}
        held = {int(w.split(":")[0]) if ":" in w else len(w) for w in counts}
        self.lengths = {n + k for n in held for k in (-2, -1, 0, 1, 2)}  # of words that two confusions may turn into one of the vocabulary

    def corrected(self, token: str) -> str | None:
        """What a token was misread from, or None if it is no misreading."""
        if token in self.known:
            return self.known[token]
        if len(self.known) > 500_000:
            self.known.clear()
        out = None
        w = token.strip(TRIM).lower()
        raw = token.strip(TRIM.replace("!", "")).lower()
        n = self.counts.get(word_key(w), 0)
        for cand in dict.fromkeys((w, raw)):
            if len(cand) < self.least or len(cand) not in self.lengths or not any(c.isalpha() for c in cand) or (n and w == raw and n >= 1000 * self.floor):
                continue
            need = self.ratio * max(n, self.floor - 1 if cand.isalpha() else 1)
            best = max(((self.counts.get(word_key(v), 0), v) for v in corrections(cand) if len(v) >= self.least), default=(0, ""))
            if best[0] >= max(need, 2) and (cand == w or n == 0):
                out = best[1]
                break
        self.known[token] = out
        return out


def page_line(line: str) -> re.Match[str] | None:
    """The match of a line that only states a page, of any length."""
    return PAGE.fullmatch(line) if DIGIT.search(line) else None


def _plain(line: str) -> bool:
    """A line of prose, not of a table or list."""
    s = line.lstrip()
    return "|" not in s and not s.startswith(("[Table]", "[/Table]", "• ", "* ", "- ", "# ", "```"))


def hard_wrapped(lines: list[str]) -> bool:
    long = [x for x in lines if _plain(x) and len(x) > 24]
    return len(long) >= 3 and max(map(len, long)) <= 110


def clean(text: str, headers: set[int], page: int | None, last_page: int, words: Words) -> tuple[list[str], str]:
    """Kinds of noise of a text, and the text without them."""
    kinds: set[str] = set()
    lines = text.split("\n")
    hashes = line_hashes(lines) if headers else None
    kept: list[str] = []
    for i, line in enumerate(lines):
        m = page_line(line)
        if m and (m["bare"] is None or int(m["bare"]) == page or 0 < int(m["bare"]) <= last_page):
            kinds.add("page_number")
        elif hashes is not None and hashes[i] in headers:
            kinds.add("running_header")
        else:
            kept.append(line)
    wrapped = hard_wrapped(kept)
    out: list[str] = []
    carry = ""  # the start of a word whose rest is on the next line
    for line in kept:
        s = line.rstrip()
        if carry and s.strip():
            head, rest = s.lstrip().split(None, 1) if len(s.split(None, 1)) == 2 else (s.strip(), "")
            left = carry[:-1]
            joined, compound = left + head, left + "-" + head
            known = lambda w: words.counts.get(word_key(w.strip(TRIM).lower()), 0)
            if head[:1].islower() or not head[:1].isalpha() or head[:1] in "@5!0+£1":
                if known(compound) and not known(joined) and carry[-1] in "-‐":
                    s = compound + (" " + rest if rest else "")
                else:
                    kinds.add("hyphen_break")
                    s = joined + (" " + rest if rest else "")
            else:
                s = carry + " " + s.lstrip()
            carry = ""
        if len(s) > 1 and s[-1] in HYPHENS and s[-2].isalnum() or len(s) > 2 and s[-1] in HYPHENS and s[-2] in "@!+£":
            cut = s.rsplit(None, 1)
            carry = cut[-1]
            s = cut[0] if len(cut) == 2 else ""
            if not s:
                continue
        out.append(s)
    if carry:
        out.append(carry)
    paragraphs: list[str] = []
    fresh = True
    for line in out:
        fixed = []
        for tok in line.split(" ") if _plain(line) else []:
            good = words.corrected(tok) if tok else None
            if good is None:
                fixed.append(tok)
                continue
            kinds.add("misread")
            core = tok.strip(TRIM) if words.corrected(tok.strip(TRIM)) else tok.strip(TRIM.replace("!", ""))
            fixed.append(tok.replace(core, good.capitalize() if core[:1].isupper() or core[:1] in "5£" and fresh and not fixed else good, 1))
        line = " ".join(fixed) if fixed else line
        if not line.strip():
            fresh = True
            continue
        if not (wrapped or kinds) or fresh or not _plain(line):
            paragraphs.append(("\n" if paragraphs and fresh else "") + line)
        else:
            paragraphs[-1] += " " + line.strip()
        fresh = not _plain(line) and bool(wrapped)
    return sorted(kinds), "\n".join(paragraphs) if kinds else text


def line_hashes(lines: list[str]) -> list[int]:
    """Hashes of the folded lines; 0 for lines that can't be headers."""
    fit = [i for i, x in enumerate(lines) if len(x.strip()) > 1 and _fit(x)]
    out = [0] * len(lines)
    if fit:
        cp, starts = code_points([fold(lines[i]) for i in fit])
        for i, h in zip(fit, span_hashes(cp, starts[:-1], starts[1:] - 1).view(np.int64).tolist()):
            out[i] = h or 1
    return out


def _fit(line: str) -> bool:
    s = line.strip()
    return s[0] not in "[•*-#`" and s[-1] not in ".,;:?!" and s.count("|") < 2 and any(c.isalpha() for c in s) and not page_line(line)


def vocabulary(docs: DataFrame, text: str, rare: float, least: int = 3) -> tuple[dict[str, int], int]:
    """Counts of the words with at least a share ``rare`` of all words, and the count from which a word is in it."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            texts = [t for t in r.column(0).to_pylist() if t]
            total: dict[str, int] = {}
            for g in batches(texts):
                cp, _ = code_points([texts[i].lower() for i in g])
                a, b = word_spans(cp)
                # Hyphenated words count as such, too.
                hy = np.flatnonzero((a[1:] - b[:-1] == 1) & (cp[b[:-1]] == 0x2D)) if len(a) > 1 else np.zeros(0, dtype=np.int64)
                a, b = np.concatenate((a, a[:-1][hy])) if len(hy) else a, np.concatenate((b, b[1:][hy])) if len(hy) else b
                _, first, n = np.unique(span_hashes(cp, a, b), return_index=True, return_counts=True)
                for i, k in zip(first.tolist(), n.tolist()):
                    w = cp[a[i] : b[i]].astype("<u4").tobytes().decode("utf-32-le", "replace")
                    w = word_key(w)
                    total[w] = total.get(w, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["w", "n"])

    words = cut_lineage(docs.select(text).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))  # counted once
    total = words.agg(F.sum("n").alias("all")).first()["all"] or 0
    floor = max(least, int(np.ceil(rare * total)))
    return {r["w"]: r["n"] for r in words.where(F.col("n") >= floor).toLocalIterator()}, floor


def running_headers(df: DataFrame, document: str, page: str, chunk: str, text: str, share: float = 0.5, plain_share: float = 0.75, least: int = 3) -> DataFrame:
    """(document, headers array<long>, last_page): the hashes of each document's running headers and footers."""

    def lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            doc, at, h, wrapped = [], [], [], []
            for d, p, t in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2).to_pylist()):
                ls = t.split("\n")
                hs = {x for x in line_hashes(ls) if x} | {0}  # 0 stands for the page itself
                doc += [d] * len(hs)
                at += [p] * len(hs)
                h += hs
                wrapped += [hard_wrapped(ls)] * len(hs)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.string()), pa.array(at, pa.string()), pa.array(h, pa.int64()), pa.array(wrapped, pa.bool_())], names=["d", "p", "h", "wrapped"])

    place = F.coalesce(F.col(page).cast("string"), F.concat(F.lit("c"), F.col(chunk).cast("string")))
    src = df.where(F.col(document).isNotNull() & F.col(text).isNotNull()).select(F.col(document).cast("string").alias("d"), place.alias("p"), F.col(text).alias("t"))
    per_page = src.mapInArrow(lines, "d string, p string, h long, wrapped boolean").groupBy("d", "h", "p").agg(F.max("wrapped").alias("wrapped"))
    per_line = per_page.groupBy("d", "h").agg(F.count_if("wrapped").alias("w"), F.count_if(~F.col("wrapped")).alias("u"))
    pages = per_line.where("h = 0").select(F.col("d").alias("pd"), F.col("w").alias("wrapped_pages"), F.col("u").alias("other_pages"))
    rows = per_line.where((F.col("h") != 0) & ((F.col("w") >= least) | (F.col("u") >= least))).join(pages, F.col("d") == F.col("pd"))
    enough = (F.col("w") >= least) & (F.col("w") >= share * F.col("wrapped_pages")) | (F.col("u") >= least) & (F.col("u") >= plain_share * F.col("other_pages"))
    found = rows.where(enough).groupBy("d").agg(F.collect_list("h").alias("headers"))  # at most lines-per-page / share
    last = df.where(F.col(document).isNotNull()).groupBy(F.col(document).cast("string").alias("ld")).agg(F.max(F.col(page)).cast("int").alias("last_page"))
    return last.join(found, F.col("ld") == F.col("d"), "left").select(F.col("ld").alias("h_doc"), "headers", "last_page")


def scan_noise(
    df: DataFrame, key: str, document: str, page: str, chunk: str, text: str, rare: float = 2e-6, ratio: float = 20.0, least: int = 4, header_share: float = 0.5
) -> DataFrame:
    """(key, kinds array<string>, clean): what each text carries, and the text repaired."""
    counts, floor = vocabulary(df, text, rare)
    shared = df.sparkSession.sparkContext.broadcast(counts)
    headers = running_headers(df, document, page, chunk, text, header_share)
    src = df.select(F.col(key).alias("k"), F.col(document).cast("string").alias("d"), F.col(page).cast("int").alias("p"), F.col(text).alias("t"))
    joined = src.join(headers, src["d"] == headers["h_doc"], "left").select("k", "p", "t", "headers", "last_page")

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value, floor, ratio, least)
        for b in rows:
            kinds, texts = [], []
            for p, t, hs, lp in zip(b["p"], b["t"], b["headers"], b["last_page"]):
                if not isinstance(t, str) or not t.strip():
                    kinds.append([]), texts.append(t if isinstance(t, str) else None)
                    continue
                k, c = clean(t, set() if hs is None else set(map(int, hs)), None if p is None or p != p else int(p), 0 if lp is None or lp != lp else int(lp), words)
                kinds.append(k), texts.append(c)
            yield pd.DataFrame({"k": b["k"], "kinds": kinds, "clean": texts})

    return joined.mapInPandas(run, f"k {df.schema[key].dataType.simpleString()}, kinds array<string>, clean string").withColumnRenamed("k", key)
