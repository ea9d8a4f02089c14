"""Document statistics that the quality models read; numpy and plain Python, for use inside tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

SYMBOLS = "#*$%&|<>"
WINDOW = 8
NAMES = (
    "log_words", "mean_word", "word_sd", "upper_share", "digit_share", "symbol_share", "mark_share", "stop_share", "distinct_share",
    "top_word_share", "dup_line_share", "repeat_share", "bare_words_a_line", "lower_start_share", "longest_run_share", "line_sd",
)
STOPS = frozenset(b"the of and to a in that is was he for it with as his on be at by der die und den von zu das mit sich des auf ist im dem nicht ein eine la de el que y en un por con no una su para es al lo como le et les des en un du une que est pour qui dans par sur".split())
MARKS = b"!?#*$%&|<>{}[]=+~^@_\\/"
ASCII_UPPER = bytes(range(65, 91))


def split_words(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`; bytes.split parts at just these six bytes."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows of `window` words that are found twice or more, the first ones included."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    runs = np.zeros(n, np.uint64)
    for k in range(window):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        runs ^= runs >> np.uint64(29)
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(codes), bool)
    for k in range(window):
        inside[k : k + n] |= twice
    return int(inside.sum())


@dataclass
class Counted:
    """A text's words: the different ones, how often each occurs, and the number of the word at each place."""

    distinct: list[bytes]
    freq: np.ndarray
    codes: np.ndarray


def counted_words(text: str) -> Counted:
    words = split_words(text)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return Counted(list(number), np.bincount(codes, minlength=len(number)), codes)


def base_counts(text: str | None) -> tuple[tuple[int, int, int, int, int], Counted]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the words."""
    text = text or ""
    words = counted_words(text)
    n = len(words.codes)
    n_space = sum(map(text.count, " \t\n\v\f\r"))
    n_symbols = sum(map(text.count, SYMBOLS))
    n_dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
        n_dup = len(lines) - len(set(lines))
    n_repeat = repeated_words(words.codes.astype(np.uint64)) if len(words.distinct) < n else 0
    return (n, len(text) - n_space, n_symbols, n_dup, n_repeat), words


def statistics(text: str | None, base: tuple, words: Counted) -> list[float]:
    """The values of NAMES for one text; all 0 where there are no words."""
    n, chars, n_symbols, n_dup, n_repeat = base
    if not n:
        return [0.0] * len(NAMES)
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    distinct, freq, codes = words.distinct, words.freq, words.codes
    lines = [len(x) for x in text.split("\n") if x]
    size = np.fromiter(map(len, distinct), np.float64, len(distinct))
    total = float(size @ freq)
    mean = total / n
    first = np.fromiter((w[0] for w in distinct), np.int64, len(distinct))
    stops = freq[np.fromiter((w in STOPS for w in distinct), bool, len(distinct))].sum()
    upper, digits, marks = (len(raw) - len(raw.translate(None, some)) for some in (ASCII_UPPER, b"0123456789", MARKS))
    ends = sum(map(raw.count, (b".", b"!", b"?")))
    line_mean = sum(lines) / max(1, len(lines))
    spread = (sum((x - line_mean) ** 2 for x in lines) / max(1, len(lines))) ** 0.5
    return [
        math.log1p(n), mean, max(0.0, float((size * size) @ freq) / n - mean * mean) ** 0.5, upper / total, digits / total,
        n_symbols / chars, marks / total, float(stops) / n, len(distinct) / n, float(freq.max()) / n, n_dup / max(1, len(lines)), n_repeat / n,
        n / max(1, ends), float(freq[(first >= 97) & (first <= 122)].sum()) / n, float(np.count_nonzero(codes[1:] == codes[:-1])) / n, math.log1p(spread),
    ]
