r"""Quality rules, line first: rules judge each line, failing lines go, and a document that
loses too much of its text goes with them.

Words are runs of bytes outside [\x20\x09-\x0D]; a null text has none. One pass over the text
in Arrow batches, no shuffle. Nulls and empty texts have zero counts and fail the base rules;
repeated rows are judged alike; other columns pass through ``clean_documents`` untouched."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagequarry.llm import textkernel as K
from pagequarry.llm.common import map_text, without

SYMBOLS = K.table(b"#*$%&|<>")
_UPPER, _LETTER = K.table(bytes(range(65, 91))), K.table(bytes(range(65, 91)) + bytes(range(97, 123)))
_SHOUT = K.table(b"!")
#: A line that ends in one of these (or in a multi-byte mark below) is a sentence's end.
_STOPS = K.table(b".!?:;\"')]}")
_STOPS_3 = (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f", b"\xe2\x80\xa6", b"\xe2\x80\x9d", b"\xe2\x80\x99")
#: Phrases of page furniture, in lower case.
BOILERPLATE = (b"lorem ipsum", b"all rights reserved", b"privacy policy", b"terms of use", b"terms of service", b"cookie policy", b"use of cookies", b"uses cookies", b"enable javascript", b"click here", b"sign up for", b"subscribe to our")
NAVIGATION = K.table(b"|<>")


@dataclass(frozen=True)
class LineRules:
    min_words: int = 20
    #: Per cent of words in 8-word windows that occur twice.
    max_repeat: int = 30
    window: int = 8
    #: Of a line: symbols a word, navigation marks a word, capitals among letters, exclamation marks a word, words equal to the one before.
    symbols: float = 0.3
    navigation: float = 0.2
    capitals: float = 0.6
    shouts: float = 0.4
    stutter: float = 0.3
    #: A line of fewer words isn't judged by its capitals.
    short: int = 4
    #: Share of its words that a document may lose.
    max_lost: float = 0.4


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICTS = ["base_failed", "kept"]


def measure(data: np.ndarray, offs: np.ndarray, rules: LineRules) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Counts and verdicts by text; (start, end, text, failed) of the lines."""
    n = len(offs) - 1
    space = K.SPACE[data]
    ws, we, wd = K.words(data, offs)
    roll = K.Rolling(data)
    wh = roll.ranges(ws, we)
    ls, le, ld = K.lines(data, offs)
    line_hash = roll.ranges(ls, le)
    n_words = np.bincount(wd, minlength=n)
    m = len(ls)
    line_of = np.searchsorted(ls, ws, side="right") - 1
    in_line = np.bincount(line_of, minlength=m)
    has_word = in_line > 0
    _, later = K.repeated(K.within(line_hash[has_word], ld[has_word]))
    again = np.zeros(m, bool)
    again[has_word] = later
    starts = K.window_starts(wd, rules.window)
    twice, _ = K.repeated(K.within(K.Rolling(wh).windows(rules.window)[starts], wd[starts]))
    in_window = K.covered(starts[twice], rules.window, len(ws))
    out = {
        "n_words": n_words, "word_chars": K.per_text(~space & ((data & 0xC0) != 0x80), offs), "n_symbols": K.per_text(SYMBOLS[data], offs),
        "n_dup_lines": np.bincount(ld[again], minlength=n), "n_repeat_words": np.bincount(wd[in_window], minlength=n),
    }
    per_line = lambda flags: K.per_text(flags, np.append(ls, len(data)))  # noqa: E731  a line's own line end is none of these
    words = np.maximum(in_line, 1)
    stutter = np.zeros(len(ws), bool)
    stutter[1:] = (wh[1:] == wh[:-1]) & (line_of[1:] == line_of[:-1])
    last = le - 1
    if len(ws):  # a line's last byte that isn't white space ends its last word
        last = np.where(has_word, we[np.maximum(np.searchsorted(ws, le) - 1, 0)] - 1, last)
    ends_well = np.zeros(m, bool)
    if len(data):
        ends_well = _STOPS[data[np.maximum(last, 0)]]
        codes = (data[np.maximum(last - 2, 0)].astype(np.int64) << 16) | (data[np.maximum(last - 1, 0)].astype(np.int64) << 8) | data[np.maximum(last, 0)]
        ends_well |= np.isin(codes, [int.from_bytes(x, "big") for x in _STOPS_3])
    n_letters = per_line(_LETTER[data])
    failed = has_word & (
        ~ends_well
        | again
        | (per_line(SYMBOLS[data]) > rules.symbols * words)
        | (per_line(NAVIGATION[data]) > rules.navigation * words)
        | (per_line(_SHOUT[data]) > np.maximum(1, rules.shouts * words))
        | ((per_line(_UPPER[data]) > rules.capitals * np.maximum(n_letters, 1)) & (in_line >= rules.short))
        | (np.bincount(line_of[stutter], minlength=m) > rules.stutter * words)
    )
    low = K.LOWER[data].tobytes()
    for phrase in BOILERPLATE:
        at = low.find(phrase)
        while at >= 0:
            k = int(np.searchsorted(ls, at, side="right")) - 1
            failed[k] |= at + len(phrase) <= le[k]
            at = low.find(phrase, at + 1)
    lost = np.bincount(ld[failed], weights=in_line[failed], minlength=n)
    out["n_lost_words"] = lost.astype(np.int64)
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat * n_words)
    out["kept"] = ~out["base_failed"] & (lost <= rules.max_lost * n_words)
    return out, (ls, le, ld, failed)


def clean_documents(df: DataFrame, text: str = "text", rules: LineRules = LineRules(), texts: bool = True) -> DataFrame:
    """df with counts, n_lost_words, base_failed, kept and, if texts, clean_text (failing lines removed;
    null stays null). A column of df with one of these names is replaced."""
    added = [*COUNTS, "n_lost_words", *VERDICTS] + ["clean_text"] * texts
    df = without(df, *added)
    names = df.columns

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column(text)
        data, offs = K.joined(column)
        got, (ls, le, ld, failed) = measure(data, offs, rules)
        cols = [*part.columns, *(pa.array(got[c].astype(np.int64)) for c in [*COUNTS, "n_lost_words"]), *(pa.array(got[c]) for c in VERDICTS)]
        if texts:
            clean = column.to_pylist()
            raw, bad = data.tobytes(), set(ld[failed].tolist())
            edge = np.searchsorted(ld, np.arange(len(offs)))
            for i in bad:
                clean[i] = b"\n".join(raw[ls[k] : le[k]] for k in range(edge[i], edge[i + 1]) if not failed[k]).decode("utf-8", "replace")
            cols.append(pa.array(clean, pa.string()))
        return pa.RecordBatch.from_arrays(cols, [*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema = kinds + "".join(f", {c} long" for c in [*COUNTS, "n_lost_words"]) + ", base_failed boolean, kept boolean" + ", clean_text string" * texts
    return map_text(df, judge, schema, text)
