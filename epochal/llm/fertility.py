"""Quality rules from tokeniser fertility.

Public vocabularies read each text; measured are characters per token, the share of tokens that are
pieces of a character only (byte fallback) and the entropy of the token counts.  The script is that of most
letters.  A text is rejected

* when it is outside its script's wide BANDS under every vocabulary, or
* when one measure under one vocabulary is an outlier among the documents of its script and language (``lang``,
  where the table has it): more than FENCE quartile distances beyond the quartiles.  Quartiles are Spark
  aggregates over all documents that pass the base, exact on values rounded to GRID decimals, so what an
  aggregate holds is bounded by the grid.  The fewer documents
  a script and language has, the wider its fences.

Base measures (whole text, words ``[^\\x20\\x09-\\x0D]+``): n_words, word_chars, n_symbols, n_dup_lines,
n_repeat_words; base_failed when n_words < 50 or 100 * n_repeat_words > 50 * n_words.  The vocabularies
read every text, once; the measures wait in a table of the shared folder for the quartiles.

Defined results: a null text counts as empty (0 words, measures 0, base_failed, not kept); null and repeated
doc_ids are carried through row by row; a very long text is read whole, alone in its piece; an empty table
gives an empty table; other columns of the input, whatever their names, are ignored (``keep`` carries them through).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm import textops as X
from epochal.llm import tokens
from epochal.llm.work import Work

VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")

SCRIPTS = ("latin", "greek", "cyrillic", "semitic", "indic", "east_asian", "none")
BANDS = {  # least and most characters per token, most byte fallback, least bits of entropy (from 100 tokens on)
    "latin": (1.4, 14.0, 0.40, 3.0),
    "greek": (0.4, 8.0, 0.95, 2.5),
    "cyrillic": (0.4, 8.0, 0.95, 2.5),
    "semitic": (0.4, 8.0, 0.95, 2.5),
    "indic": (0.2, 8.0, 1.0, 2.0),
    "east_asian": (0.2, 6.0, 1.0, 2.0),
    "none": (1.0, 14.0, 0.60, 2.0),
}
FENCE, FEW, GRID = 2.5, 20, 3  # fences are 1 + FEW / n times as wide where n documents set them
FLOORS = {"per_token": 0.05, "fallback": 0.01, "entropy": 0.1}  # least quartile distances: equal texts make no outliers

_OF_BYTE = np.full(256, 6, dtype=np.int64)  # by the byte that opens a letter
_OF_BYTE[65:91] = _OF_BYTE[97:123] = 0
_OF_BYTE[0xC3:0xCA] = 0
_OF_BYTE[0xCD:0xD0] = 1
_OF_BYTE[0xD0:0xD4] = 2
_OF_BYTE[0xD6:0xDC] = 3
_OF_BYTE[0xE0] = 4
_OF_BYTE[0xE3:0xEE] = 5
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each text of a piece."""
    n = len(offsets) - 1
    starts, ends, bounds = X.word_spans(data, offsets)
    words = X.span_hashes(data, starts, ends)
    counts = np.diff(bounds)
    opens = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    in_words = np.concatenate([[0], np.cumsum(opens[ends] - opens[starts])])
    text = np.repeat(np.arange(n), counts)

    repeated = np.zeros(len(words), dtype=bool)
    if len(words) >= 3:
        first = np.flatnonzero(np.arange(len(words)) + 2 < bounds[1:][text])
        key = X.mix(X.mix(X.mix(words[first] + text[first].astype(np.uint64)) + words[first + 1]) + words[first + 2])
        _, which, often = np.unique(key, return_inverse=True, return_counts=True)
        again = first[often[which] > 1]
        for k in range(3):
            repeated[again + k] = True

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    owner = np.searchsorted(offsets[:-1], line_starts, side="right") - 1
    line_ends = np.minimum(offsets[1:][owner], np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)]) if n else line_starts
    owner_ok = line_starts <= line_ends
    # a line start at the very end of a text belongs to that text and is empty: it has no word anyway
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    use = owner_ok & has_word
    key = X.mix(X.span_hashes(data, line_starts[use], line_ends[use]) + owner[use].astype(np.uint64)) if use.any() else np.zeros(0, np.uint64)
    _, at = np.unique(key, return_index=True)
    later = np.ones(len(key), dtype=np.int64)
    later[at] = 0
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": in_words[bounds[1:]] - in_words[bounds[:-1]],
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(owner[use], weights=later, minlength=n).astype(np.int64),
        "n_repeat_words": _per_text(repeated, bounds),
    }


def _scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    of = _OF_BYTE[data]
    votes = np.stack([_per_text(of == k, offsets) * (1 if k < 6 else 0) for k in range(7)], axis=1)
    votes[:, 6] = votes.max(axis=1) == 0
    return votes.argmax(axis=1)


def fertility(text: bytes, path: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share and entropy in bits."""
    ids = tokens.encoder(path).encode_to_numpy(text.decode("utf-8"))
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    chars = int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())
    return len(ids), chars / len(ids), float(tokens.fragments(path)[ids].mean()), float(-(share * np.log2(share)).sum())


def within(script: str, measured: tuple[int, float, float, float], bands: dict = BANDS) -> bool:
    low, high, fallback, bits = bands[script]
    n, per_token, share, entropy = measured
    return low <= per_token <= high and share <= fallback and (n < 100 or entropy >= bits)


def default_paths() -> tuple[str, ...]:
    return tuple(tokens.public_path(v) for v in VOCABULARIES)


def _judge(texts: pa.Array, paths: tuple[str, ...], rules: dict) -> Iterator[tuple[int, int, dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece: first, last + 1, base measures, base_failed, scripts, measures (vocabularies x 4 x texts), kept by the bands."""
    for first, last, data, offsets in X.pieces(texts):
        base = base_measures(data, offsets)
        failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
        scripts = _scripts(data, offsets)
        measured = np.full((len(paths), 4, last - first), np.nan)
        kept = np.zeros(last - first, dtype=bool)
        raw = data.tobytes()
        for i in range(last - first):
            own = [fertility(raw[offsets[i] : offsets[i + 1]], p) for p in paths]
            measured[:, :, i] = own
            kept[i] = not failed[i] and any(within(SCRIPTS[scripts[i]], m, rules) for m in own)
        yield first, last, base, failed, scripts, measured, kept


def verdicts(texts: pa.Array, paths: tuple[str, ...], bands: dict = BANDS) -> np.ndarray:
    """Inside the bands, for each text; the fences need the whole table (``quality``, ``keep``)."""
    return np.concatenate([np.zeros(0, dtype=bool), *(piece[-1] for piece in _judge(texts, paths, bands))])


def _own_names(columns: list[str]) -> tuple[str, str, str]:
    """Names for measures, fences and verdict that no column has (whatever its case)."""
    taken, end = {c.lower() for c in columns}, ""
    while taken & {f"{x}{end}" for x in ("_f", "_q", "_kept")}:
        end += "_"
    return f"_f{end}", f"_q{end}", f"_kept{end}"


def _measure(docs: DataFrame, columns: list[str], paths: tuple[str, ...], rules: dict, name: str = "_f") -> DataFrame:
    """The given columns of every document, and its measures under the given name."""
    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, lang string, banded boolean"
    kinds += "".join(f", {name}{k} double" for k in range(len(paths)) for name in FLOORS)
    fields = [kind.split()[0] for kind in kinds.split(", ")]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    given_text = "text" in columns and docs.schema["text"].dataType.simpleString() == "string"  # then it travels once
    text = F.lit(None).cast("string") if given_text else F.col("text").cast("string")
    given = docs.select(*columns, F.struct(text.alias("text"), lang.alias("lang")).alias(name))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + f", {name} struct<" + ", ".join(kind.replace(" ", ": ") for kind in kinds.split(", ")) + ">"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang = batch.column(name).flatten()
            text = batch.column("text") if given_text else text
            for first, last, base, failed, scripts, measured, kept in _judge(text, paths, rules):
                n = last - first
                arrays = [*(pa.array(v) for v in base.values()), pa.array(failed), pa.array([SCRIPTS[k] for k in scripts], pa.string()), lang.slice(first, n), pa.array(kept), *(pa.array(m, from_pandas=True) for own in measured for m in own[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n) for c in columns), pa.StructArray.from_arrays(arrays, fields)], [*columns, name])

    return given.mapInArrow(work, schema)


def _fenced(measured: DataFrame, n_vocabularies: int, own_names: tuple[str, str, str] = ("_f", "_q", "_kept")) -> DataFrame:
    """Adds the verdict (the third name): inside the bands, and no outlier of its script and language under any vocabulary."""
    f, q, kept = own_names
    names = [f"{name}{k}" for k in range(n_vocabularies) for name in FLOORS]
    quartiles = [F.percentile(F.round(F.col(f"{f}.{x}"), GRID), F.array(F.lit(0.25), F.lit(0.75))).alias(x) for x in names]
    own = measured.where(f"not {f}.base_failed").groupBy(F.col(f"{f}.script").alias("script"), F.col(f"{f}.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"), *quartiles)
    fences = own.select(F.struct("script", "lang", "n", *names).alias(q))
    good = F.lit(True)
    for x in names:
        value, low, high = F.round(F.col(f"{f}.{x}"), GRID), F.col(f"{q}.{x}")[0], F.col(f"{q}.{x}")[1]
        reach = FENCE * (1 + FEW / F.col(f"{q}.n")) * F.greatest(high - low, F.lit(FLOORS[x.rstrip("0123456789")]))
        if not x.startswith("fallback"):  # few pieces of characters are no fault
            good = good & (value >= low - reach)
        if not x.startswith("entropy"):
            good = good & (value <= high + reach)
    same = (F.col(f"{f}.script") == F.col(f"{q}.script")) & F.col(f"{f}.lang").eqNullSafe(F.col(f"{q}.lang"))
    out = measured.join(F.broadcast(fences), same, "left")  # a row for each script and language
    return out.withColumn(kept, F.col(f"{f}.banded") & (F.col(q).isNull() | good)).drop(q)


def quality(docs: DataFrame, vocabularies: tuple[str, ...] | None = None, bands: dict | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed, script, the first vocabulary's measures and kept, per document."""
    paths = vocabularies or default_paths()
    named = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    measured = Work(docs.sparkSession, "fertility").cut(_measure(named, ["doc_id"], paths, bands or BANDS), "measures")
    base = [F.col(f"_f.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "script")]
    return _fenced(measured, len(paths)).select("doc_id", *base, F.col("_f.per_token0").alias("chars_per_token"), F.col("_f.fallback0").alias("fallback_share"), F.col("_f.entropy0").alias("token_entropy"), F.col("_kept").alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that ``quality`` keeps."""
    paths = default_paths()
    own = _own_names(docs.columns)
    measured = Work(docs.sparkSession, "fertility").cut(_measure(docs, docs.columns, paths, BANDS, own[0]), "measures")
    return _fenced(measured, len(paths), own).where(own[2]).select(*docs.columns)
