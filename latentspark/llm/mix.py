"""Mixing sources to target token shares.

Documents get a hash-random key; inside each source the tokens are prefix-summed in key order (see
operators.ranks), and the source is cut where its budget is reached: whole epochs first, then the part
of one more epoch, up to the cap on repeats.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.operators.ranks import buckets_for, hash_prefix

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pattern by which this byte-level vocabulary splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, NEAR = 100_000, 2_000
# One blank or line break between two other characters: the pattern above always begins a match there,
# so that the pieces on both sides have as many tokens as the whole.
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
MAX_BROADCAST_ROWS = 100_000  # of mix targets


def _encoding(path: str):
    """Loaded once per worker process."""
    import tiktoken

    loaded = tiktoken.__dict__.setdefault("_vocabularies_by_path", {})
    if path not in loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        loaded[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return loaded[path]


def pieces(s: str, chunk: int = CHUNK) -> Iterator[str]:
    """``s`` in pieces of about ``chunk`` characters, cut only where tokens surely end."""
    at = 0
    while len(s) - at > chunk:
        cut = None
        for cut in _CUT.finditer(s, max(at + 1, at + chunk - NEAR), at + chunk):
            pass
        cut = cut or _CUT.search(s, at + chunk)
        if cut is None:
            break
        yield s[at : cut.start()]
        at = cut.start()
    yield s[at:]


def count_tokens(df: DataFrame, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without the text, with ``tokens``: NULL and empty texts have 0. Arrow batches; no shuffle.

    Long texts are encoded in pieces (see ``pieces``), whose counts add up to the text's own. The
    vocabulary file must be readable under the same path on every executor."""
    rest = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "tokens bigint"])
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            tokens = [sum(len(encode(p)) for p in pieces(s)) if s else 0 for s in b[text]]
            out = b.drop(columns=[text])
            out["tokens"] = tokens
            yield out

    return df.select(*[f"`{f.name}`" for f in rest], f"`{text}`").mapInPandas(run, schema)


def source_key(c: Column) -> Column:
    """One spelling per source: lower case, no outer blanks, underscores for hyphens."""
    return F.translate(F.lower(F.trim(c, F.lit(" \t\r\n "))), "-", "_")


def shares(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source of a mix: tokens there are, wanted, reachable (capped by max_repeats), the
    target and reached shares, and whether the target is met.

    sized: (source, tokens). total_tokens: size of each mix, by default that of all of ``sized``
    (documents whose source no mix names included). Source names are compared as ``source_key``; a
    source that two rows of a mix name gets both targets. Sources without documents have 0 tokens.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    if total_tokens is None:
        total_tokens = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    t = targets.select("mix_id", "source", "target_pct", "max_repeats").join(have, "source", "left")
    known = F.coalesce("source_tokens", F.lit(0)).alias("source_tokens")
    t = t.select("mix_id", "source", "target_pct", "max_repeats", known, F.lit(float(total_tokens)).alias("mix_tokens"))
    wanted = F.col("target_pct") / 100.0 * F.col("mix_tokens")
    cap = F.col("max_repeats") * F.col("source_tokens").cast("double")
    t = t.withColumns({"wanted": wanted, "budget": F.least(wanted, cap), "met": wanted <= cap})
    sums = t.groupBy("mix_id").agg(F.sum("budget").alias("reached_tokens"))
    t = t.join(sums, "mix_id")
    return t.withColumn("budget_pct", F.coalesce(F.try_divide(100.0 * F.col("budget"), F.col("reached_tokens")), F.lit(0.0)))


def mix(sized: DataFrame, plan: DataFrame, doc_id: str) -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies) with copies >= 1.

    A document is in the last, partial epoch when its tokens start before the remaining budget, so a
    source overshoots by less than one document. sized: (doc_id, source, tokens).
    """
    rows = sized.count()
    keyed = sized.select(doc_id, "source", "tokens").withColumn("_h", F.xxhash64(F.lit("mix"), F.col(doc_id)))
    ordered = hash_prefix(keyed, ["source"], "_h", doc_id, F.col("tokens"), buckets_for(rows))
    p = plan.filter("budget > 0").select("mix_id", "source", "source_tokens", "max_repeats", "budget")
    if plan.count() <= MAX_BROADCAST_ROWS:  # a row per source of a mix; documents then stay where they are
        p = F.broadcast(p)
    p = p.withColumn("_epochs", F.floor(F.col("budget") / F.col("source_tokens")))
    p = p.withColumn("_rest", F.col("budget") - F.col("_epochs") * F.col("source_tokens"))
    x = ordered.join(p, "source")
    copies = F.least(F.col("_epochs") + F.when(F.col("before") < F.col("_rest"), 1).otherwise(0), F.col("max_repeats"))
    x = x.withColumn("copies", copies.cast("int"))
    return x.filter("copies > 0").select("mix_id", "source", doc_id, "tokens", "copies")


def reached(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per source of a mix: the tokens and the share that the selection really has, and whether
    they fall short of the tokens wanted."""
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    all_of = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    r = plan.select("mix_id", "source", "target_pct", "max_repeats", "wanted", "met").join(got, ["mix_id", "source"], "left").join(all_of, "mix_id", "left")
    r = r.withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    pct = F.coalesce(F.try_divide(100.0 * F.col("tokens"), F.col("mix_tokens")), F.lit(0.0)).alias("reached_pct")
    short = (F.col("tokens") < F.col("wanted")).alias("short")
    return r.select("mix_id", "source", "target_pct", "max_repeats", "met", "tokens", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), pct, short)
