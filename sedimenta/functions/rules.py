"""Rules on whole texts, in plain Python over Arrow batches: repeats within a document, Gopher's and C4's quality rules.

A text is walked once; as Spark expressions the same rules are interpreted lambdas over
arrays of tokens and lines, some ten times slower.  White space is ASCII's where lines
and words are split.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from . import arrays as A

CJK = re.compile(r"^(zh|cmn|yue|wuu|nan|ja|jpn|ko|kor)")
_BLANK = re.compile(rb"\n\s*\n")


_SCRIPTS: dict[tuple, np.ndarray] = {}


def script_table(scripts: tuple) -> np.ndarray:
    """By code point: the number of its script among ``scripts`` (name, pattern), from 1 on; made once a process."""
    if scripts not in _SCRIPTS:
        import regex

        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
        out = np.zeros(0x110000, np.uint8)
        for i, (_, pattern) in enumerate(scripts):
            for m in regex.finditer(f"(?:{pattern.replace('{Is', '{Script=')})+", every):
                out[m.start() : m.end()] = i + 1
        _SCRIPTS[scripts] = out
    return _SCRIPTS[scripts]


def languages(profiles: dict[str, str], scripts: tuple = ()):
    """(doc_id, language, text) to (doc_id, language, stop words by profile) and, with ``scripts``, the script of most letters, if any, and whether the text is blank.

    Words are compared in lower case without the punctuation at their ends; of scripts with equally many letters it is the first in the alphabet.
    """
    stops = {k: [w.encode() for w in p.split()] for k, p in profiles.items()}
    latin = next((s for s, _ in scripts if s == "Latn"), None)

    def script(text: str) -> str | None:
        if latin and text.isascii():
            return latin if text.swapcase() != text else None
        n = np.bincount(script_table(scripts)[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=len(scripts) + 1)[1:].tolist()
        least, name = min((-c, s) for c, (s, _) in zip(n, scripts))
        return name if least else None

    def run(batches):
        for batch in batches:
            counts, found, blank = [], [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").lower().encode().split()
                seen = Counter([w.rstrip(b".,;:!?") for w in words])
                counts.append([sum(seen[w] for w in ws) for ws in stops.values()])
                if scripts:
                    found.append(script(text or ""))
                    blank.append(not words)
            cols = [pa.array(list(c), pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * len(stops)
            if scripts:
                cols += [pa.array(found, pa.string()), pa.array(blank, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("language"), *cols], ["doc_id", "language", *stops, *(["script", "blank"] if scripts else [])])

    return run


def cjk_share(chars: np.ndarray) -> float:
    """Share of code points that are Chinese, Japanese or Korean, as ``text.cjk_share`` has it."""
    n = np.count_nonzero(((chars >= 0x3000) & (chars <= 0x9FFF)) | ((chars >= 0xAC00) & (chars <= 0xD7AF)))
    return n / len(chars) if len(chars) else 0.0


def lines(text: str) -> list[str]:
    """Lines without their ends; a last line feed opens no further line."""
    return text.removesuffix("\n").split("\n")


def unit_shares(units: list[bytes]) -> tuple[float, float]:
    """Shares of units, and of their characters, that repeat an earlier one; blank ones don't count."""
    kept = [u for u in (b" ".join(x.split()) for x in units) if u]
    if not kept:
        return 0.0, 0.0
    size = lambda some: sum(len(u) if u.isascii() else len(u.decode()) for u in some)
    once = dict.fromkeys(kept)
    if len(once) == len(kept):
        return 0.0, 0.0
    total = size(kept)
    return (len(kept) - len(once)) / len(kept), (total - size(once)) / max(total, 1)


def repeats(ngrams: tuple[int, ...]):
    """(doc_id, text) to (doc_id, token_count, shares of repeated lines, paragraphs and their characters, top n-gram shares)."""
    units = ("duplicate_line_fraction", "duplicate_line_char_fraction", "duplicate_paragraph_fraction", "duplicate_paragraph_char_fraction")
    names = [*units, *(f"top_{n}gram_fraction" for n in ngrams)]

    def run(batches):
        for batch in batches:
            texts = [(t or "").lower() for t in batch.column("text").to_pylist()]
            found = []
            for t in texts:
                raw = t.encode()
                found.append((*unit_shares(raw.split(b"\n")), *unit_shares(_BLANK.split(raw))))
            cols = dict(zip(units, np.array(found, float).reshape(-1, 4).T))
            cols |= {n: np.zeros(len(texts)) for n in names[4:]}
            count = np.zeros(len(texts), np.int64)
            sizes = np.r_[0, np.cumsum([len(t) for t in texts])]
            for lo, hi in A.parts(sizes):
                chars, at = A.code_points(texts[lo:hi])
                starts, ends, firsts = A.tokens(chars, at)
                h = A.hashes(chars, starts, ends)
                size = count[lo:hi] = np.diff(firsts)
                for n in ngrams:
                    share = (A.most_frequent(h, firsts, n) - 1) * n / np.maximum(size, 1)
                    cols[f"top_{n}gram_fraction"][lo:hi] = np.where(size < 2 * n, 0.0, np.minimum(share, 1.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), *(pa.array(cols[n]) for n in names)], ["doc_id", "token_count", *names])

    return run, names


def gopher(punctuation: str, bullets: str, stops_en: tuple[str, ...], stops_zh: tuple[str, ...]):
    """(text, language) to the first rule that fails, else none."""
    import regex

    symbol = np.zeros(0x110000, bool)
    symbol[[ord(c) for c in punctuation]] = True
    letter = regex.compile(r"\p{L}")

    def reason(text: str, language: str | None) -> str | None:
        chars, at = A.code_points([text])
        starts, ends, _ = A.tokens(chars, at)
        n = len(starts)
        if not n:
            return "empty"
        visible = np.r_[0, np.cumsum(~symbol[chars])]
        real = visible[ends] > visible[starts]
        m = int(real.sum())
        if m < 50:
            return "too_few_words"
        if m > 100_000:
            return "too_many_words"
        lang = (language or "").lower()
        cjk = bool(CJK.match(lang))
        mean = int((ends - starts)[real].sum()) / m
        if mean < (1.3 if cjk else 3.0):
            return "avg_word_too_short"
        if mean > 10:
            return "avg_word_too_long"
        if text.count("#") / n > 0.1:
            return "too_many_hashes"
        if (text.count("...") + text.count("…")) / n > 0.1:
            return "too_many_ellipsis"
        ls = lines(text)
        if sum(x.lstrip(" \t\n\r\x0b\f")[:1] in bullets and not x.isspace() and x != "" for x in ls) > 0.9 * len(ls):
            return "too_many_bullet_lines"
        if sum(x.rstrip(" \t\n\r\x0b\f").endswith(("...", "…")) for x in ls) > 0.3 * len(ls):
            return "too_many_ellipsis_lines"
        if text.isascii():
            low = chars | 32
            alpha = np.r_[0, np.cumsum((low >= 97) & (low <= 122))]
            some = int((alpha[ends] > alpha[starts]).sum())
        else:
            some = sum(bool(letter.search(text, a, b)) for a, b in zip(starts.tolist(), ends.tolist()))
        if some / n < 0.6:
            return "too_many_non_alpha_words"
        if cjk or not lang or lang.startswith("en"):
            words = {text[a:b] for a, b in zip(starts.tolist(), ends.tolist())}
            if (len(words & set(stops_zh)) if cjk else len({w.lower() for w in words} & set(stops_en))) < 2:
                return "not_enough_stop_words"
        return None

    return reason


_CITE = re.compile(r"\[[0-9]*\]|\[edit\]|\[citation needed\]")
_SENTENCE = re.compile(r"[.!?][\"')\]]*[ \t\n\r\x0b\f]+")
_SENTENCE_CJK = re.compile("[。！？…；;]+")
_EDGES = " \t\n\r\x0b\f"


def c4(policies: tuple[str, ...], policies_cjk: tuple[str, ...]):
    """(text, language) to the first rule that fails, else none."""

    def reason(text: str, language: str | None) -> str | None:
        cjk = bool(CJK.match((language or "").lower()))
        ends = "。！？”’.?!\"'" if cjk else ".?!\"'"
        stated = policies_cjk if cjk else policies
        n = 0
        for raw in lines(text):
            words = raw.encode().split()
            if len(words) < (2 if cjk else 3) or (len(raw) > 1000 and any(len(w.decode()) > 1000 for w in words)):
                continue
            line = _CITE.sub("", raw.strip(_EDGES))
            if line[-1:] not in ends or not line or line.endswith("..."):
                continue
            low = line.lower()
            if "lorem ipsum" in low:
                return "lorem_ipsum"
            if "javascript" in low:
                continue
            if "{" in line:
                return "curly_bracket"
            if any(p in low for p in stated):
                continue
            if cjk:
                n += sum(bool(s.strip(_EDGES)) for s in _SENTENCE_CJK.split(line))
            else:
                at = [m.end() for m in _SENTENCE.finditer(line)]
                n += len(at) + (not at or at[-1] < len(line))
        return None if n >= 5 else "too_few_sentences"

    return reason


def reasons(rules: dict[str, object], default_language: str):
    """(doc_id, text, language) to the reasons of each rule."""

    def run(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("language").to_pylist()
            rows = [(t or "", l or default_language) for t, l in zip(texts, langs)]
            cols = [pa.array([rule(t, l) for t, l in rows], pa.string()) for rule in rules.values()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", *(f"{k}_reason" for k in rules)])

    return run
