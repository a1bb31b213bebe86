"""Keyword-stuffed and link-list pages.

Each text is read as a sequence of terms: links, tags and words, with the marks between them; code, logs,
data and identifiers are marked apart and count as proper text. Two measures are taken at each place:

* recurrence: a content term that returns. Its gaps tell how: after at most ``NEAR`` places; or, at any
  distance, with regular gaps (gap after gap differs by at most 1 and an eighth, for at least as many gaps
  as one of them has sentence words, ``RETURNS`` at least); or together with its neighbours, when the
  positional autocorrelation of all terms at one of the lags 1 to ``LAGS`` stays above ``PERIODIC`` over
  a lag window of ``RETURNS`` periods. Sentences rarely return to a term so soon, so regularly or so wholly.
* sentence words: their share among the terms of a window. Lists of keywords, tags or links have almost none,
  sentences of every language need them. They aren't listed here but come from the corpus: frequent words
  that are spread over documents of running text and far rarer in pages that look like lists. Where few of
  them are met, the terms must also be links, tags, known words of the corpus or the short, regularly parted
  items of a list; so a language that the corpus hardly has isn't taken for a list of nouns.

A place is stuffed if the first measure is high or the second low. The score of a text is the share of
its characters at stuffed places; a case is a text with a score above one half and at least ``LEAST``
terms (a link counts twice), or, made of hardly anything else, 3 links or 8 tags: short replies with a link
or two are none.

Scale: two narrow maps over Arrow batches. The first counts documents per word inside each batch and adds
the counts up; what is kept is a word per ``SPREAD`` of all documents at most, hence at most (mean number of
distinct words of a document) / ``SPREAD`` words, whatever the corpus; these are broadcast. A text of any length
is handled whole, in time linear in its length. The measures are taken over arrays of a whole batch.
Nothing else is shuffled unless a table has fewer splits than cores.

Cases: null, empty and blank texts have score 0. Hidden characters and letter case are ignored, links in
HTML or Markdown are read as the link and its words, whatever form the target has. Hosts without a scheme
are links if their suffix is one of ``SUFFIX``, or any but a file's before a path; ``a.pl`` alone is a file.
Repeated texts get the same score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.plans.scratch import Scratch
from pedlake.sources.tables import spread

NEAR, HALF, RETURNS, LAGS, PERIODIC = 5, 8, 4, 64, 0.7
FEW_SENTENCE, MUCH_RECURRENCE, AMONG_ALL, AT_ALL, PARTED, KNOWN = 0.18, 0.5, 0.35, 0.6, 0.2, 0.5
LEAST, SHARE, NAMES = 16, 0.5, 5
#: A word of the corpus is known from this share of the documents in its writing and this number on; a sentence
#: word is LIFT times more frequent in running text than in pages that look like lists, and no longer than SHORT.
SPREAD, FEWEST, LIFT, SHORT = 0.001, 5, 4.0, 12
#: Share of the characters that bare links or tags take; texts scored at a time.
BARE, BLOCK = 0.8, 512

HIDDEN = re.compile("[­​-‏‪-‮⁠﻿]")
CONTROLS = dict.fromkeys((1, 2, 3, 4), " ")
MARKS = re.compile("[\x01-\x04]")
FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)", re.S | re.I)
HREF = re.compile(r"<a\b[^<>]*?href\s*=\s*[\"']?([^\"'\s<>]++)[^<>]*+>", re.I)
HTML = re.compile(r"</?[a-zA-Z][^<>]*>")
MARKDOWN = re.compile(r"\[([^\[\]\n]*)\]\(\s*+([^()\s]++)[^()\n]*+\)")
INLINE = re.compile(r"`([^`\n]*)`")
LINK = re.compile(r"(?:https?://|www\.|\x04)\S+")
#: Suffixes of a bare host. Before a path any suffix of letters will do, but for those of files.
SUFFIX = "com net org info biz edu gov example shop store online site web blog club top xyz vip app dev io co eu de fr uk es ru ua pt br jp cn kr ca au nl ch se fi dk cz gr hu ro tr mx ar cl tv it at be us nz ie no sk lt lv ee bg hr si kz by il za sg hk tw th vn ph my рф".split()
FILE = "py sh pl rs md so js ts go rb cc cpp hpp java html htm php asp txt csv tsv json xml yaml yml log vcf bam bed bim fam ped map gz zip tar bz pdf png jpg conf cfg ini sql exe dll lib bin dat tmp bak old".split()
HOST = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}_@/:.\-=\\`\x04])(?://)?(?:[\p{{Latin}}\p{{Cyrillic}}\p{{Greek}}\p{{Nd}}][\p{{Latin}}\p{{Cyrillic}}\p{{Greek}}\p{{Nd}}\-]*+\.)+"
    rf"(?:(?!(?:{'|'.join(FILE)})\b)\p{{L}}{{2,24}}(?::\d+)?/[^\s<>()\[\]\"'\x01-\x04]*|(?:{'|'.join([*SUFFIX, *map(str.upper, SUFFIX)])})(?![\p{{L}}\p{{N}}_(\-]|\.[\p{{L}}\p{{N}}_]))"
)
DOTTED = re.compile(r"[^\W_]\.[^\W\d_]{2}")
LOG = re.compile(r"^\W{0,3}(?:\d[\d:.,TZ\-/ ]{0,60}\W{0,20})?(?:\[[\d:., \-TZ]+\]\s*)?(?:WARN|WARNING|ERROR|INFO|DEBUG|TRACE|FATAL)\b")
SYMBOL = re.compile(r"[(){}\[\]=<>\\_&`\"]")
#: Quoted or bracketed groups of words, not an index, a call, a key or a nested list.
GROUP = regex.compile(r"""(?<![\p{L}\p{N}_)\]=:\[({])(?:"([\p{L}\p{N}][\p{L}\p{M}\p{N}'’ ,\-]*+)"|\[([\p{L}\p{N}][\p{L}\p{M}\p{N}'’ ,\-]*+)\]|\(([\p{L}\p{N}][\p{L}\p{M}\p{N}'’ ,\-]*+)\)|\{([\p{L}\p{N}][\p{L}\p{M}\p{N}'’ ,\-]*+)\}|<([\p{L}][\p{L}\p{M}\p{N}'’ ,\-]*+)>)(?!\s*[=:]|[(\[\])}])""")
#: Words of letters joined by underscores, in a row.
JOINED = regex.compile(r"[\p{L}\p{M}]+(?:_[\p{L}\p{M}]+)+")
JOINED_ROW = regex.compile(rf"(?:{JOINED.pattern}[\s,;|]*+){{3,}}")
#: What an indented line of code has: an assignment, a call, a path or option, a number, a block's end.
SHAPE = re.compile(r"[=(){}\[\]<>\\|&$@*^]|\w[:;]\s*$|;\s|::|\w_\w|(?:^|\s)[-~./]+\w|(?:^|[\s,])\d|^(?:for|while|if|else|elif|def|class|import|from|return|try|except|print|cd|ls|cat|grep|awk|sed|git|pip|sudo|export|echo)\b")
STATEMENT = re.compile(r"[;{}]\s*$|\s-[a-z][\w-]*[\s=]|<-|::|->|=>")
COMMAND = re.compile(r"^(?:\$ |>>> |#!|//(?!\x04)|--\w)\s?\S|\s--[a-z][\w-]*[\s=]")
#: Links, tags, words, numbers, marked code and letters, separators and ends of sentences, in lines of ASCII and of any writing.
_REST = r"|[0-9][0-9%s.,:/%%\-]*|\x02[0-9]+|\x03[0-9]+|[,;|/%s]|(?<=\s)[\-%s](?=\s)|[.!?](?=\s|$)"
ASCII_TERM = re.compile(r"\x04\S+|(?:https?://|www\.)[^\s<>()\[\]\"']+|#[A-Za-z0-9][\w\-]*|[A-Za-z][A-Za-z0-9'_\-]*(?:[./][A-Za-z0-9_]+)*" + _REST % ("A-Za-z", "", ""), re.ASCII)
TERM = regex.compile(r"\x04\S+|(?:https?://|www\.)[^\s<>()\[\]\"']+|[#＃][\p{L}\p{N}][\p{L}\p{M}\p{N}_\-]*|[\p{L}\p{M}][\p{L}\p{M}\p{N}'’_\-]*(?:[./][\p{L}\p{N}_]+)*" + (_REST % (r"\p{L}", "•·▪、，；", "–—")).replace("[0-9][0-9", r"\p{N}[\p{N}", 1) + "|[。！？؟।]")
IDENTIFIER = re.compile(r"^(?:[A-Za-z]+[0-9][A-Za-z0-9_.\-]*|NA|NaN)$")
#: Writing without blanks: runs of kana, single Han characters and up to four letters of other scripts are terms.
WRITING = regex.compile(r"[\p{Katakana}ー]+|[\p{Hiragana}]+|\p{Han}|[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{1,4}")
HIRAGANA = regex.compile(r"\p{Hiragana}")
#: Words with digits or signs for letters.
SIGNED_HINT = re.compile(r"[^\W\d_][0134579$@]+[^\W\d_]")
SIGNED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[0134579$@])[\w$@\-]+(?!\S)")
LETTERS = str.maketrans("0134579$@", "oieastgsa")
SPACED_HINT = re.compile(r"(?:^| )\w \w \w \w \w ")
SPACED = regex.compile(r"(?<![^\s])\p{Ll}(?:\s{1,3}[\p{L}\p{N}](?![^\s])){15,}", regex.I)


def _keywords(row: str) -> bool:
    """Joined words of three parts or more, or ones whose parts return: phrases rather than names of columns."""
    joined = JOINED.findall(row.lower())
    parts = [p for j in joined for p in j.split("_")]
    return len(parts) >= 3 * len(joined) or len(set(parts)) <= 0.6 * len(parts)


WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
PART = re.compile(r"[,;|/•·、，；\n]|\s[\-–—]\s")
APART = re.compile(r"[#＃]\w[\w\-]*|(?:https?://|www\.)\S+|[*_`]{1,3}")
END = re.compile(r"[.!?](?=\s|$)|[。！？؟।]")


class Words(dict):
    """Words of the corpus: those of sentences, and all that are known. As a dictionary, how tokens met so far are read:
    (kind, term, characters) each, or a mark."""

    MOST = 200_000

    def __init__(self, sentence: Iterable[str] = (), known: Iterable[str] = ()):
        super().__init__()
        self.sentence = frozenset(sentence)
        self.known = frozenset(known) | self.sentence

    def __reduce__(self):
        return Words, (self.sentence, self.known)

    def __missing__(self, t: str) -> tuple[tuple[str, str, int], ...] | int:
        got = self._read(t)
        if len(t) <= 40:
            if len(self) >= self.MOST:
                self.clear()
            self[t] = got
        return got

    def _kind(self, word: str) -> str:
        return "f" if word in self.sentence else "k" if word in self.known else "w"

    def _read(self, t: str) -> tuple[tuple[str, str, int], ...] | int:
        c = t[0]
        if c in ".!?。！？؟।":
            return 2
        if c in ",;|/•·▪、，；-–—":
            return 1
        if c == "\x04":
            return (("u", t[1:].lower(), len(t) - 1),)
        if c in "\x02\x03":
            return (("d" if c == "\x02" else "x", "", int(t[1:])),)
        if c in "#＃":
            return (("t", t.lower(), len(t)),)
        if c == "w" and t.startswith("www.") or c == "h" and t.startswith(("http://", "https://")):
            return (("u", t.lower(), len(t)),)
        if not (c.isalpha() or unicodedata.category(c)[0] == "M"):
            return (("n", t.lower(), len(t)),)
        low = t.lower()
        if low in self.sentence:
            return (("f", low, len(t)),)
        if "_" in t or "." in t or "/" in t or IDENTIFIER.match(t):
            return (("d", t, len(t)),)
        if not t.isascii() and WRITING.search(t):
            return tuple(("f" if HIRAGANA.match(x) else self._kind(x), x, 2 * len(x)) for x in WRITING.findall(t))
        if low not in self.known:
            low = low.replace("’", "'")
        return ((self._kind(low), low, len(t)),)


NONE = Words()


def terms(text: str, words: Words = NONE) -> list[tuple[str, str, int, int]]:
    """(kind, term, characters, mark before): kinds are u link, t tag, k known word, w other word, f sentence word,
    n number, d code or data, x spaced letters; marks 1 a separator or new line, 2 the end of a sentence, else 0."""
    if MARKS.search(text):
        text = text.translate(CONTROLS)
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "`" in text or "~" in text or "<" in text:
        text = FENCE.sub(lambda m: f"\n\x01{len(m.group())}\n", text)
    if "<" in text:
        text = HTML.sub("\n", HREF.sub(" \x04\\1 ", text))
    if "](" in text:
        text = MARKDOWN.sub(" \x04\\2 \\1 ", text)
    if DOTTED.search(text):
        text = " ".join(HOST.sub("\x04\\g<0>", w) if "." in w else w for w in text.split(" "))
    out, names = [], []
    add, read, mark = out.append, words.__getitem__, 0
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        mark = mark or 1
        if s[0] == "\x01":
            add(("d", "", int(s[1:]), mark))
            continue
        if len(SIGNED_HINT.findall(s)) >= 3:  # more than a third of the words, so no names among words
            s = SIGNED.sub(lambda m: m.group().translate(LETTERS), s) if 3 * len(SIGNED.findall(s)) >= len(s.split()) else s
        plain = LINK.sub(" ", s) if "://" in s or "www." in s else s
        ticks = "`" in s
        if ticks:
            plain = INLINE.sub(" ", plain)
        symbols = len(SYMBOL.findall(plain))
        if symbols:
            if "_" in plain and JOINED_ROW.fullmatch(plain) and _keywords(plain):
                s = plain = plain.replace("_", " ")
            plain = GROUP.sub(lambda m: next(filter(None, m.groups())), plain)
            symbols = len(SYMBOL.findall(plain))
        if LOG.match(s) or (line.startswith(("    ", "\t")) and not LINK.search(s) and SHAPE.search(plain)) or symbols > 0.05 * len(plain) + 1 or COMMAND.search(s) or (symbols and STATEMENT.search(plain)):
            add(("d", "", len(s) - s.count("\x04"), mark))
            mark = 0
            continue
        # words written letter by letter hide their terms: one stuffed place, unless it is a data row
        if SPACED_HINT.search(s):
            s = SPACED.sub(lambda m: f" \x03{len(m.group())} " if len(set(m.group().lower())) > 7 else m.group(), s)
        first = len(out)
        tokens = (ASCII_TERM if s.isascii() else TERM).findall(INLINE.sub(lambda i: f" \x02{len(i.group(1))} ", s) if ticks else s)
        for got in map(read, tokens):
            if got == 1 or got == 2:
                mark = 2 if got == 2 else mark or 1
                continue
            for r in got:
                add((*r, mark))
                mark = 0
        if not any(r[0] == "d" and r[1] for r in out[first:]):
            continue
        places = [i for i in range(first, len(out)) if out[i][0] == "d" and out[i][1].isalnum() and out[i][1] not in ("NA", "NaN")]
        if places and not any(out[i][0] == "n" for i in range(first, len(out))):
            names += places
    # names with digits that return are products or tags rather than a listing; beside numbers they are data
    often = Counter(out[i][1] for i in names) if names else {}
    for i in names:
        if often[out[i][1]] >= NAMES:
            out[i] = ("w", out[i][1].lower(), *out[i][2:])
    return out


def _around(x: np.ndarray, half: int = HALF) -> np.ndarray:
    """Sums of each row over the window of ``half`` places to both sides."""
    n = x.shape[1]
    c = np.zeros((len(x), n + 2 * half + 1), dtype=np.int32)
    np.cumsum(x, axis=1, out=c[:, half + 1 : half + 1 + n])
    c[:, half + 1 + n :] = c[:, half + n : half + n + 1]
    return c[:, 2 * half + 1 :] - c[:, :n]


def _returning(ids: np.ndarray, content: np.ndarray, sentence: np.ndarray, maybe: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of content terms that return soon or regularly, and all places that return with their neighbours.
    ids differ between texts; begin is the first place of each place's text."""
    out, periodic = np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool)
    place = np.flatnonzero(content | sentence)
    place = place[np.argsort(ids[place], kind="stable")]
    after = np.flatnonzero(ids[place[1:]] == ids[place[:-1]])  # gap k lies between places after[k] and after[k] + 1
    if not len(after):
        return out, periodic
    one, two = place[after], place[after + 1]
    gap = two - one
    soon = gap <= NEAR
    out[one[soon]] = out[two[soon]] = True

    # regular gaps: runs of gaps that follow each other within one term and stay alike
    passed = np.cumsum(sentence | maybe)
    need = np.where(content[one], np.maximum(RETURNS, passed[two] - passed[one]), len(ids))
    first = np.ones(len(after), dtype=bool)
    first[1:] = (np.diff(after) != 1) | (np.abs(np.diff(gap)) > 1 + gap[:-1] // 8)
    start = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    ok = np.arange(len(after)) - start[run] + 1 >= need
    if ok.any():
        upto = np.full(len(start), -1)
        np.maximum.at(upto, run[ok], np.flatnonzero(ok))
        marked = np.arange(len(after)) <= upto[run]
        out[one[marked]] = out[two[marked]] = True

    # positional autocorrelation: the share of terms in a lag window that equal the term a lag before
    term = ids >= 0
    total = np.concatenate(([0], np.cumsum(term)))
    lags = np.bincount(gap[gap <= LAGS], minlength=LAGS + 1)
    for lag in np.flatnonzero(lags >= RETURNS):
        if lag <= NEAR:
            continue
        same = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum((ids[lag:] == ids[:-lag]) & term[lag:], out=same[lag + 1 :])
        ends = np.arange((RETURNS + 1) * lag, len(ids) + 1)
        width = lag * np.maximum(RETURNS, passed[ends - 1] - passed[ends - 1 - lag])
        inside = begin[ends - 1] <= ends - width - lag
        ends, width = ends[inside], width[inside]
        high = same[ends] - same[ends - width] >= PERIODIC * (total[ends] - total[ends - width])
        if high.any():
            cover = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(cover, ends[high], -1)
            np.add.at(cover, ends[high] - width[high] - lag, 1)
            periodic |= np.cumsum(cover)[:-1] > 0
    return out, periodic


def score_all(texts: list[str | None], words: Words = NONE) -> list[tuple[float, int, bool]]:
    """For each text the share of its characters at stuffed places, the number of terms (links twice), and whether it is stuffed."""
    out: list[tuple[float, int, bool]] = [(0.0, 0, False)] * len(texts)
    kinds, mass, marks, ids, begin, spans = [], [], [], [], [], []
    at = base = 0
    for j, text in enumerate(texts):
        read = terms(text, words) if text else []
        if not read:
            continue
        ks, ts, ms, ps = zip(*read)
        code: dict[str, int] = {}
        ids += [base + code.setdefault(t, len(code)) for t in ts]
        base += len(code)
        kinds.append("".join(ks))
        mass += ms
        marks += ps
        spans.append((j, at, at + len(read)))
        # places between the texts, which belong to none
        kinds.append("0" * HALF)
        ids += [-1] * HALF
        mass += [0] * HALF
        marks += [0] * HALF
        begin += [at] * len(read) + [at + len(read) + HALF] * HALF
        at += len(read) + HALF
    if not spans:
        return out
    kind = np.frombuffer("".join(kinds).encode(), dtype=np.uint8)
    ids, mass, marks = (np.array(x, dtype=np.int32) for x in (ids, mass, marks))

    def is_(*ks: str) -> np.ndarray:
        known = np.zeros(256, dtype=bool)
        known[[ord(k) for k in ks]] = True
        return known[kind]

    function, proper, spaced, content = is_("f"), is_("d"), is_("x"), is_("u", "t", "k", "w")
    # short words that the corpus doesn't know may be those of a sentence: they make a phrase return more often
    again, periodic = _returning(ids, content, function, is_("w") & (mass <= 3), np.array(begin))
    f, p, c, r, rf, known, parts, ends = _around(np.array([function, proper, content, again & content, again & function, is_("u", "t", "k"), marks == 1, marks == 2]))
    counted = c + f  # a long block of code is one place
    few = f < FEW_SENTENCE * np.maximum(counted, 1)
    listed = (known >= KNOWN * c) | ((parts >= PARTED * counted) & (4 * ends < parts))
    high = (r >= MUCH_RECURRENCE * np.maximum(c, 1)) & (r >= AMONG_ALL * counted)
    high |= (r + rf >= AT_ALL * counted)
    stuffed = ((few & listed) | high | periodic) & ~proper & (counted > 0) & (p <= counted) | spaced
    at_stuffed = np.concatenate(([0], np.cumsum(np.where(stuffed, mass, 0))))
    sums = np.concatenate(([0], np.cumsum(mass)))
    letters = np.concatenate(([0], np.cumsum(np.where(spaced, mass // 8, 0))))
    weights = np.concatenate(([0], np.cumsum(content.astype(int) + function + is_("u"))))
    links, tags = (np.concatenate(([0], np.cumsum(is_(k)))) for k in "ut")
    apart = np.concatenate(([0], np.cumsum(np.where(is_("u", "t"), mass, 0))))
    for j, a, z in spans:
        total = sums[z] - sums[a]
        weight = int(weights[z] - weights[a] + letters[z] - letters[a])
        if not total or not weight:
            out[j] = (0.0, weight, False)
            continue
        share = float((at_stuffed[z] - at_stuffed[a]) / total)
        bare = apart[z] - apart[a] >= BARE * total and (links[z] - links[a] >= 3 or tags[z] - tags[a] >= 8)
        out[j] = (share, weight, bool(share > SHARE and (weight >= LEAST or bare)))
    return out


def score(text: str | None, words: Words = NONE) -> tuple[float, int]:
    """Share of the characters at stuffed places, and the number of terms (links twice)."""
    return score_all([text], words)[0][:2]


def _listed_words(words: list[str], text: str) -> list[str]:
    """Of a page that is likely a list (many short parts without sentences, or few words over and over), the
    words of the short or repetitive parts; else none. For the counts only."""
    n, ends = len(words), len(END.findall(text))
    if n < LEAST or 20 * ends > n or (4 * len(PART.findall(text)) < n and 4 * len(set(words)) > n):
        return []
    parts = [w for p in PART.split(text) for w in [_split(p)] if w]
    got = [x for w in parts if len(w) <= 5 or (len(w) >= LEAST and 4 * len(set(w)) <= len(w)) for x in w]
    return got if 2 * len(got) >= n else []


def _split(text: str) -> list[str]:
    words = WORD.findall(text)
    return words if text.isascii() else [x for w in words for x in (WRITING.findall(w) or (w,))]


def corpus_words(documents: DataFrame, text: str = "text", share: float = SPREAD, key: str = "doc_id") -> Words:
    """Words known to the corpus and its sentence words, from the number of documents that hold them.

    Shares are those of the documents in the word's own writing (Latin, Cyrillic and so on)."""
    rows = spread(documents.select(key, text), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spread_over, counts = Counter(), (Counter(), Counter())
            for t in b.column(1).to_pylist():
                if not t or len(SYMBOL.findall(t)) > 0.02 * len(t):
                    continue
                t = APART.sub(", ", t.lower() if t.isascii() else HIDDEN.sub("", unicodedata.normalize("NFKC", t)).lower())
                t = SPACED.sub(", ", t) if SPACED_HINT.search(t) else t
                words = _split(t)
                apart = Counter(_listed_words(words, t))
                counts[0].update(words)
                counts[0].subtract(apart)
                counts[1].update(apart)
                spread_over.update(set(words))
                spread_over.update({"\x01" + _writing(w) for w in words})
            for c in counts:
                for w, m in list(c.items()):
                    c["\x01" + _writing(w)] += m
            keys = [k for k in spread_over if len(k) <= 40]
            names = [k[1:] if k[0] == "\x01" else _writing(k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (spread_over, *counts))], names=["writing", "word", "df", "plain", "listed"])

    sums = rows.mapInArrow(run, "writing string, word string, df long, plain long, listed long").groupBy("writing", "word").agg(*(F.sum(c).alias(c) for c in ("df", "plain", "listed")))
    counted = Scratch(documents.sparkSession, "words").cut(sums.where(F.col("df") >= FEWEST))
    whole = counted.where(F.startswith("word", F.lit("\x01"))).select("writing", *(F.col(c).alias(f"{c}_all") for c in ("df", "plain", "listed")))  # a row per writing
    kept = counted.where(~F.startswith("word", F.lit("\x01"))).join(F.broadcast(whole), "writing").where(F.col("df") >= share * F.col("df_all"))
    rate = LIFT * F.col("listed") / (F.col("listed_all") + 1000) < F.col("plain") / F.greatest("plain_all", F.lit(1))
    got = kept.select("word", (rate & (F.length("word") <= SHORT)).alias("s")).collect()  # at most (mean number of distinct words of a document) / share rows a writing
    return Words((r["word"] for r in got if r["s"]), (r["word"] for r in got))


def _writing(word: str) -> str:
    c = ord(word[0])
    return "latin" if c < 0x370 or 0x1E00 <= c < 0x1F00 else "han" if 0x3400 <= c < 0xA000 or c > 0x20000 else str(c >> 7 if c < 0x1100 else c >> 12)


def stuffed(documents: DataFrame, key: str = "doc_id", text: str = "text", words: Words | None = None) -> DataFrame:
    """(key, score, n_terms, stuffed) for every row. Words are those of the documents themselves unless given."""
    data = documents.sparkSession.sparkContext.broadcast(corpus_words(documents, text, key=key) if words is None else words)
    rows = spread(documents.select(key, text), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                s, n, hit = zip(*score_all(part.column(1).to_pylist(), data.value))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array(n, pa.int32()), pa.array(hit, pa.bool_())], names=[key, "score", "n_terms", "stuffed"])

    return rows.mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, score double, n_terms int, stuffed boolean")
