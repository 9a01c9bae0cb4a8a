"""Texts that were cut off: a structural check of how each text ends, against what is usual for its source.

A stack automaton reads every text as a whole. Of structured texts (JSON, from its first line that opens one) whatever is still open at the
end - strings, escapes, brackets - was cut. Of all others it follows brackets, quotations and questions of any script, elements of markup, and code
fences; what prose opens and doesn't close by the end of its paragraph is a slip, what is open where the text ends was cut. A broken
multibyte sequence, an unfinished escape, entity or tag at the very end tells the same. Otherwise the last line decides: prose
has to end with a terminator; lines that stand alone (titles, bullets, keywords, table rows, signatures, addresses) have to end with
a word such lines end with elsewhere in the corpus. A marker of omission at the end (an ellipsis, "[truncated]", "(more)") is taken off
first; what stands before it is judged, and an explicit marker counts by itself unless the sentence before it is complete.

A missing terminator only counts in sources that usually set one. A cut only changes the end of a text, so the baseline is taken from
what stands before it: of the source's other texts, those that end with a terminator or end their inner paragraphs (without any,
inner sentences) with one. Besides, a missing terminator counts where texts that tell nothing inside pile up at the greatest
length of their source with varied last words, as a field limit leaves them. A source of single paragraphs that habitually leaves out just
the last terminator can't be told from one that cuts most of its texts, and counts as cutting.

The corpus statistics cover all texts: counts by source, and the last words of standing lines, items of keyword lines and inner bullets,
of which only those with at least a share ``rare`` are broadcast - at most 1/``rare`` of each kind. Standing lines of a kind are
compared, in tables of any size, if at least a share ``usual`` of their words are such common ones.

Defined results: a text alone in its source has no baseline and lacks no terminator; null, blank and empty texts and texts of one short word are not cut; null sources form one source; repeated texts get
the same verdict. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import cut_lineage

# What senders put behind a cut.
MARKER = re.compile(r"\s*(?:…|\[\s*(?:truncated|\.\.\.|…|cut|more)\s*\]|\(\s*(?:more|truncated|continued|cont\.?|\.\.\.|…)\s*\)|<\s*(?:truncated|snip|cut)\s*>|(?:read|show|see) more\s*(?:…|\.\.\.|»)?|\[?message clipped\]?)\s*$", re.I)
BROKEN = re.compile(r"(?:�+|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|(?<!\\)\\|&#?[A-Za-z0-9]{1,8}|<|%[0-9A-Fa-f]?)$")
STOPS, CLOSERS = ".!?。！？‽", "\"'”’»)]*_`"
SENTENCE = re.compile(r"[.!?。！？‽][\"'”’»)\]*_`]*\s")
PARAGRAPHS = re.compile(r"(?:\r\n|[\r\n])[^\S\r\n]*(?:\r\n|[\r\n])")
BULLETS = re.compile(r"(?m)^[^\S\n]*(?:[-*•+]|\d+[.)])\s+(\S.*)$")
ITEMS = re.compile(r"(?m)^\w[\w ]{1,20}: ((?:[^,.;:\n]{1,40}, )+)[^,.;:\n]{1,40}$")
STRUCTURE = re.compile(r"(?:\A|\n)[^\S\n]*[\[{]")
KEY = re.compile(r'"\s*:')
TAIL = 160  # longer than anything the patterns of the end can match
TOKEN = re.compile(r"```|~~~|\\.|[\"()\[\]{}“”«»„¿?]|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|(?:\r\n|[\r\n])[^\S\r\n]*(?:\r\n|[\r\n])", re.S)
OPENS = {")": "(", "]": "[", "}": "{", "”": "“", "?": "¿"}
END_TAGS = re.compile(r"(?:\s*</[A-Za-z][A-Za-z0-9]*>)+$")
# Elements of markup that have to be closed.
ELEMENTS = set("a abbr article aside b blockquote body button code div em figure footer form h1 h2 h3 h4 h5 h6 head header html i label main nav ol pre script section select small span strong style sub sup table tbody textarea thead title u ul".split())
PAIRS = {")": "(", "]": "[", "}": "{"}
STANDING = [
    ("signature", re.compile(r"[—–-]{1,2}\s?\w[\w .]{0,30}\s\d+$")),
    ("keywords", re.compile(r"\w[\w ]{1,20}: (?:[^,.;:]{1,40}, )+[^,.;:]{1,40}$")),
    ("bullet", re.compile(r"(?:[-*•+]|\d+[.)])\s+\S.*$")),
    ("table", re.compile(r"\|.*\|$")),
    ("address", re.compile(r"https?://\S+$")),
    ("fence", re.compile(r"(?:```|~~~)\w*$")),
    ("heading", re.compile(r"#{1,6}\s+\S.*$")),
    ("title", re.compile(r"[^\W\d_][^.!?;:,]*$")),
]
TITLE_WORDS = 8


def open_structure(text: str) -> bool | None:
    """Whether JSON that starts in the text is still open at its end; None if there is no JSON."""
    if '"' not in text:
        return None
    m = STRUCTURE.search(text)
    if not m or not KEY.search(text, m.start()):
        return None
    stack: list[str] = []
    i, n = m.end() - 1, len(text)
    token = re.compile(r'["\\\[\]{}]')
    quoted = False
    while True:
        t = token.search(text, i)
        if not t:
            return quoted or bool(stack)
        c, i = t[0], t.end()
        if quoted:
            if c == "\\":
                i += 1
                if i > n:
                    return True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append(c)
        elif c in "]}":
            if stack and stack[-1] == PAIRS[c]:
                stack.pop()


def ends_sentence(line: str) -> bool:
    """Whether a line ends with a terminator, behind which only quotes, brackets and marks may close."""
    return line.rstrip(CLOSERS)[-1:] in STOPS and line.rstrip(CLOSERS) != ""


def unclosed(text: str) -> set[str]:
    """What a text opens and doesn't close: 'bracket' (or quotation, or question), 'markup', 'fence'."""
    stack: list[str] = []

    def close(opener: str) -> bool:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] == opener:
                del stack[i:]
                return True
        return False

    fence, quotes = "", 0
    for m in TOKEN.finditer(text):
        c, i = m[0], m.start()
        if c in ("```", "~~~"):
            if text[text.rfind("\n", 0, i) + 1 : i].strip() == "":
                fence = "" if fence == c else fence or c
        elif fence or c[0] == "\\":
            continue
        elif c[0] in "\r\n":
            stack[:] = [x for x in stack if len(x) > 1]  # slips of prose
        elif c[0] == "<":
            name = re.match(r"</?([A-Za-z0-9]+)", c)[1].lower()
            if name in ELEMENTS and not c.endswith("/>"):
                close(f"<{name}>") if c[1] == "/" else stack.append(f"<{name}>")
        elif c in OPENS:
            close(OPENS[c])
        elif c == '"':
            inch = text[i - 1 : i].isdigit() and not text[i + 1 : i + 2].isalnum()
            if not close(c):
                stack += [] if inch else [c]
            quotes += c in stack or not inch
        elif c == "“":
            close("„") or stack.append(c)
        elif c in "«»":  # either may open
            other = "»" if c == "«" else "«"
            if not close(other) and (c == "«" or text[i + 1 : i + 2].isalnum() and not text[i - 1 : i].strip()):
                stack.append(c)
        elif not (c == "(" and text[i - 1 : i] in (":", ";")):
            stack.append(c)
    if quotes % 2 == 0:  # straight quotation marks close each other over paragraphs, too
        close('"')
    return {"markup" if len(x) > 1 else "bracket" for x in stack} | ({"fence"} if fence else set())


def unfinished_tag(text: str) -> bool:
    i = text.rfind("<")
    return i >= 0 and bool(re.match(r"<[/!]?[A-Za-z][^<>\n]*$", text[i:]))


def last_line(text: str) -> tuple[str, bool]:
    """The last line with content, and whether it stands alone in its paragraph (or its list)."""
    t = text.rstrip()
    cut = max(t.rfind("\n"), t.rfind("\r"))
    if cut < 0:
        return t.strip(), True
    head = t[:cut].removesuffix("\r")
    before = head[max(head.rfind("\n"), head.rfind("\r")) + 1 :].strip()
    return t[cut + 1 :].strip(), not before or before[0] in "|#•+*-" or before.startswith("```")


def standing_kind(line: str, alone: bool) -> str | None:
    """Kind of a line that ends without a terminator as such lines do."""
    for kind, p in STANDING:
        if p.match(line):
            if kind == "title":
                words = line.split()
                return kind if alone and len(words) <= TITLE_WORDS and words[0][:1].isupper() else None
            return kind
    return None


def end_words(line: str, kind: str) -> list[str]:
    """What has to be usual for a line of its kind: its last word, and of titles the first as well."""
    if kind == "address":
        return [line.rstrip("/").rsplit("/", 1)[-1]]
    words = re.findall(r"[\w’'-]+", line)
    if not words:
        return []
    return [words[-1], "^" + words[0]] if kind in ("title", "heading") else [words[-1]]


def look(text: str) -> tuple[list[str], str | None, list[str]]:
    """(reasons that don't depend on the corpus, kind of the standing last line, its words to compare). A reason 'terminator' is
    subject to the source's baseline."""
    t = text.strip("﻿​ \t\r\n\f\v\xa0")
    if not t or (len(t) <= 8 and len(t.split()) == 1):
        return [], None, []
    reasons = []
    if m := BROKEN.search(t[-TAIL:]):
        reasons.append("broken")
        t = t[: len(t) - len(m[0])].rstrip("�")
    elif unfinished_tag(t):
        reasons.append("broken")
        t = t[: t.rfind("<")]
    m = MARKER.search(t[-TAIL:])
    if m and len(m[0]) < len(t):
        t = t[: len(t) - len(m[0])]
        if not ends_sentence(t.rstrip()):
            reasons.append("marker")
    is_open = open_structure(t)
    if is_open is not None:
        return reasons + (["structure"] if is_open else []), None, []
    reasons += sorted(unclosed(t))
    line, alone = last_line(END_TAGS.sub("", t) if t.endswith(">") else t)
    if ends_sentence(line):
        return reasons, None, []
    kind = standing_kind(line, alone)
    if kind is None:
        return [*reasons, "terminator"], None, []
    return reasons, kind, [] if kind in ("signature", "table", "fence") else end_words(line, kind)


def word_key(word: str) -> str:
    """Words of more than 200 characters are counted and sent by a hash."""
    return word if len(word) <= 200 else hashlib.blake2b(word.encode("utf-8", "surrogatepass")).hexdigest()


def sets_terminators(text: str) -> bool:
    """Whether a text with an open end sets terminators before it, where no cut could remove them."""
    *inner, last = [p for p in PARAGRAPHS.split(text) if p.strip()] or [""]
    ends = [last_line(p)[0] for p in inner]
    prose = [ends_sentence(e) for e in ends if ends_sentence(e) or standing_kind(e, True) is None]
    return 2 * sum(prose) > len(prose) if prose else bool(SENTENCE.search(last))


def inner_ends(text: str) -> list[tuple[str, str]]:
    """(kind, word) of how standing lines end within a text, where no cut can be: headings, bullets before the last line, and all but the
    last item of keyword lines."""
    out = [("title", w) for h in re.findall(r"(?m)^#{1,6}\s+(\S.*?)\s*$", text) for w in end_words(h, "heading")] if "#" in text else []
    body = text[: text.rstrip().rfind("\n") + 1]
    out += [("bullet", w) for b in BULLETS.findall(body) if not ends_sentence(b) for w in end_words(b, "bullet")]
    if ", " in text:
        out += [("keywords", w) for line in ITEMS.findall(text) for item in line.split(", ") for w in end_words(item, "keywords")]
    return out


def _statistics(docs: DataFrame) -> DataFrame:
    """(kind, word, last, at, n) over all texts: end words of standing lines; and per source the texts, their greatest length, and with
    their lengths and last words those with an open end that set no terminator before it."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, str, str, int]] = Counter()
        longest: dict[str, int] = {}
        for r in rows:
            for source, text in zip(r.column(0).to_pylist(), r.column(1).to_pylist()):
                if not text:
                    continue
                reasons, kind, words = look(text)
                source = source or ""
                total["source", source, "", 0] += 1
                longest[source] = max(longest.get(source, 0), len(text))
                if "terminator" in reasons and not sets_terminators(text):
                    total["bare", source, word_key(text.split()[-1]), len(text)] += 1
                for w in words:
                    total["title" if kind == "heading" else kind, word_key(w), "", 0] += 1
                for k, w in inner_ends(text):
                    total[k, word_key(w), "", 0] += 1
        for source, n in longest.items():
            total["longest", source, "", n] = 1
        columns = [pa.array([k[i] for k in total], pa.string()) for i in range(3)] + [pa.array([k[3] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "word", "last", "at", "n"])

    return docs.mapInArrow(count, "kind string, word string, last string, at int, n long").groupBy("kind", "word", "last", "at").agg(F.sum("n").alias("n"))


def _baselines(stats: DataFrame) -> DataFrame:
    """(b_source, n, bare, limit): ``limit`` is the length at which bare texts pile up, if there is one."""
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    at = stats.where("kind in ('source', 'bare', 'longest')").groupBy("word", "kind", "at").agg(F.sum("n").alias("n"), F.count("*").alias("lasts"))
    by = at.groupBy(F.col("word").alias("b_source")).agg(
        F.sum(of("source", "n")).alias("n"), F.coalesce(F.sum(of("bare", "n")), F.lit(0)).alias("bare"), F.max(of("longest", "at")).alias("longest"),
        F.max(F.when(F.col("kind") == "bare", F.struct("at", "n", "lasts"))).alias("top"),
    )
    piled = (F.col("top.at") == F.col("longest")) & (F.col("top.n") >= 3) & (2 * F.col("top.lasts") >= F.col("top.n"))
    return by.select("b_source", "n", "bare", F.when(piled, F.col("longest")).alias("limit"))


def cut_texts(df: DataFrame, key: str, source: str, text: str, rare: float = 0.002, usual: float = 0.5) -> DataFrame:
    """(key, source, reasons array<string>): every row; cut texts have reasons."""
    docs = df.select(F.col(key), F.col(source), F.col(text))
    stats = cut_lineage(_statistics(docs.select(source, text)))
    words = stats.where("kind not in ('source', 'bare', 'longest')")
    totals = {r["kind"]: r["n"] for r in words.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # as many rows as kinds
    common: dict[str, set[str]] = {k: set() for k in totals}
    told = dict.fromkeys(totals, 0)
    for k, n in totals.items():
        least = max(2, int(rare * n))
        for r in words.where((F.col("kind") == k) & (F.col("n") >= least)).collect():  # at most 1/rare rows
            common[k].add(r["word"])
            told[k] += r["n"]
    regular = {k for k, n in totals.items() if told[k] >= usual * n}
    shared = df.sparkSession.sparkContext.broadcast((common, regular))
    base = _baselines(stats)

    def judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, regular = shared.value
        for r in rows:
            out, bare = [], []
            for text in r.column(2).to_pylist():
                reasons, kind, words = look(text) if text else ([], None, [])
                group = "title" if kind == "heading" else kind
                if words and group in regular and not all(word_key(w) in common[group] for w in words):
                    reasons.append("line")
                out.append(reasons)
                bare.append(len(text) if "terminator" in reasons and not sets_terminators(text) else None)
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(out, pa.list_(pa.string())), pa.array(bare, pa.int32())], names=[key, source, "reasons", "bare_at"])

    # Texts stay where they are: only keys and reasons meet the baseline of their source.
    kinds = df.schema[key].dataType.simpleString(), df.schema[source].dataType.simpleString()
    judged = docs.mapInArrow(judge, f"`{key}` {kinds[0]}, `{source}` {kinds[1]}, reasons array<string>, bare_at int")
    joined = judged.join(base, F.coalesce(F.col(source), F.lit("")) == F.col("b_source"), "left")
    # Of the other texts of the source; a text whose reasons hold a terminator is one that was counted.
    bare = F.col("bare") - F.when(F.col("bare_at").isNotNull(), 1).otherwise(0)
    counts = (F.col("n") > 1) & (F.col("n") - 1 - bare >= usual * (F.col("n") - 1)) | F.coalesce(F.col("bare_at") == F.col("limit"), F.lit(False))
    reasons = F.when(counts, F.col("reasons")).otherwise(F.array_remove("reasons", "terminator"))
    return joined.select(key, source, reasons.alias("reasons"))


def truncation_rates(cut: DataFrame, source: str) -> DataFrame:
    """(source, n_texts, n_cut, share_cut)."""
    n = F.count_if(F.size("reasons") > 0)
    return cut.groupBy(source).agg(F.count("*").alias("n_texts"), n.alias("n_cut"), F.round(n / F.count("*"), 6).alias("share_cut"))
