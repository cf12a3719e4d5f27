"""Quality rules, line first: failing lines go, then documents that lost too much text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import on_workers, prefix_hash, span_hash

#: Phrases of boilerplate lines in English, French, German and Spanish.
PHRASES = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "licensed under", "javascript", "subscribe", "sign in", "log in", "click here", "read more", "share on",
    "politique de confidentialité", "mentions légales", "tous droits réservés", "cliquez ici", "en savoir plus", "lire la suite", "se connecter", "s'abonner",
    "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "impressum", "hier klicken", "weiterlesen", "mehr erfahren", "jetzt anmelden",
    "política de privacidad", "política de cookies", "aviso legal", "todos los derechos reservados", "haga clic", "leer más", "iniciar sesión",
)
BOILERPLATE = re.compile("|".join(re.escape(p) for p in PHRASES))
#: Marks that menus are joined with, and that list items start with.
JOINTS, BULLET = re.compile(r"\s[|>»·•/]\s|\|"), re.compile(r"\s*(?:[•▪◦‣●*–-]|\d{1,3}[.)])\s")
SYMBOL = re.compile(r"[#*$%&|<>]")
NO_LETTER = re.compile(r"[\W\d_]+")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
ENDS = tuple(".!?:;\"'”»)…")


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that occur at least twice in the text."""
    if len(words) <= window:
        return 0
    buf = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.append(np.flatnonzero(buf == 32), len(buf))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - window + 1
    h = span_hash(prefix_hash(buf), starts[:n], ends[window - 1 :])
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(count[back] > 1)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def line_fails(line: str, n: int) -> str | None:
    """The rule that a line of n words fails, or None.

    Boilerplate: a line of at most 40 words with one of the PHRASES. Navigation: two joints of menus, one or two words
    without a mark at the end, or up to 6 capitalised words without any mark. List: a bullet and at most 6 words without
    a mark at the end. Punctuation: a teaser cut off by dots, a symbol for every other word, or less than half letters.
    """
    if n <= 40 and BOILERPLATE.search(line.lower()):
        return "boilerplate"
    end = line.rstrip()
    closed = end.endswith(ENDS)
    if n <= 25 and len(JOINTS.findall(line)) >= 2 or n <= 2 and not closed:
        return "navigation"
    if n <= 6 and not closed:
        if BULLET.match(line):
            return "list"
        if all(w[:1].isupper() for w in end.split()):
            return "navigation"
    if n <= 30 and end.endswith(("...", "…")):
        return "punctuation"
    if 2 * len(SYMBOL.findall(line)) > n:
        return "punctuation"
    letters = len(NO_LETTER.sub("", line))
    if 2 * letters < len(line) and 2 * letters < sum(map(len, line.split())):
        return "punctuation"
    return None


def judge(text: str | None, most_lost: int = 70) -> dict:
    """All figures of one text, its kept lines and the verdict."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    seen: set[str] = set()
    lines, dup, left = [], 0, 0
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if own:
            dup += line in seen
            seen.add(line)
            if line_fails(line, len(own)):
                continue
            left += len(own)
        lines.append(line)
    repeat = repeated_words(words)
    failed = n < 20 or 100 * repeat > 30 * n
    return {
        "n_words": n,
        "word_chars": sum(len(w) for w in words) - int(np.count_nonzero((np.frombuffer(b"".join(words), np.uint8) & 0xC0) == 0x80)),
        "n_symbols": int(SYMBOLS[np.frombuffer(raw, np.uint8)].sum()),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": not failed and 100 * (n - left) <= most_lost * n,
        "n_lost_words": n - left,
        "cleaned": "\n".join(lines),
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, cleaned string"


def clean_lines(docs: DataFrame, most_lost: int = 70) -> DataFrame:
    """One row per row of docs: doc_id, the figures, the verdict, the text without its failing lines.

    A document is rejected if it has under 20 words, if over 30 % of them stand in repeated 8-word
    windows, or if its failing lines hold over most_lost % of its words. Null text is empty: no words,
    rejected. Repeated rows stay, as do rows without a doc_id; other columns are not read. An empty table gives
    an empty result.
    """
    on_workers(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([judge(t, most_lost) for t in pdf["text"]], columns=[x.split()[0] for x in SCHEMA.split(", ")])
            yield pd.concat([pdf["doc_id"].reset_index(drop=True), out], axis=1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id long, {SCHEMA}")
