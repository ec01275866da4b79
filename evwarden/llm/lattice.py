"""Language-model scores of documents from a lattice over subword pieces.

Every way to cut a word into pieces of an existing vocabulary counts: the
probability of a word is the sum over all of them, by a forward recursion in log space.  A document is its
words and an end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evwarden.llm.common import ROWS_PER_BLOCK, map_blocks, stored, text_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The most frequent tokens, whose scores are sent to every task; all others are joined.
SENT_TOKENS = 50_000
#: Distinct tokens that a task gathers before it passes their counts on.
GATHERED = 200_000
#: The end of a text; no word can be equal to it.
END = "\n"
_WORD_START = "▁"


@dataclass
class Pieces:
    """Natural log probabilities of a vocabulary's pieces, by their UTF-8 bytes; single bytes always have one."""

    scores: dict[bytes, float]
    end: float
    reach: dict[bytes, int]  # the longest piece that starts with these two bytes

    @staticmethod
    def build(scores: dict[bytes, float], end: float) -> Pieces:
        reach: dict[bytes, int] = {}
        for piece in scores:
            reach[piece[:2]] = max(reach.get(piece[:2], 1), len(piece))
        return Pieces(scores, end, reach)

    def log_probability(self, word: str) -> float:
        """ln of the sum over all segmentations of the word."""
        text = (_WORD_START + word).encode()
        n = len(text)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        get, reach, exp, log = self.scores.get, self.reach.get, math.exp, math.log
        into[0] = [0.0]
        before = 0.0
        for i in range(n):
            terms = into[i]
            if not terms:
                continue
            before = terms[0]
            if len(terms) > 1:
                top = max(terms)
                before = top + log(sum([exp(t - top) for t in terms]))
            into[i] = terms = []
            for j in range(i + 1, min(n, i + reach(text[i : i + 2], 1)) + 1):
                score = get(text[i:j])
                if score is not None:
                    into[j].append(before + score)
        top = max(into[n])
        return top + math.log(sum(math.exp(t - top) for t in into[n]))


def _vocabulary(path: str) -> tuple[bytes, dict[int, bytes]]:
    """The model file and the bytes of each of its pieces, without control pieces."""
    import sentencepiece

    with open(path, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = {}
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            pieces[i] = bytes([int(name[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[i] = name.encode()
    return model, pieces


def _counter(block: int):
    """Counts of tokens, in training rows and in all, passed on whenever ``block`` distinct ones are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        train: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BLOCK):
                part = batch.slice(at, ROWS_PER_BLOCK)
                for text, held in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = text.encode().lower().split()
                    words.append(b"\n")
                    (every if held else train).update(words)
                if len(every) + len(train) >= block:
                    yield _pack(every, train)
                    every.clear()
                    train.clear()
        yield _pack(every, train)

    return run


def _pack(held: Counter, train: Counter) -> pa.RecordBatch:
    tokens = list(held.keys() | train.keys())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([t.decode() for t in tokens], pa.string()),
            pa.array([train[t] for t in tokens], pa.int64()),
            pa.array([train[t] + held[t] for t in tokens], pa.int64()),
        ],
        names=["token", "c", "n"],
    )


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, c, n): occurrences in the training rows and in all rows of (text, held_out)."""
    parts = rows.select("text", "held_out").mapInArrow(_counter(GATHERED), "token string, c bigint, n bigint")
    return parts.groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_pieces(spark: SparkSession, counts: DataFrame, vocabulary: str) -> Pieces:
    """Scores of the vocabulary's pieces from the training words, as its own tokenizer cuts them; half a count is added to each.

    What comes to the driver is at most one row for each piece of the vocabulary.
    """
    model, used = _vocabulary(vocabulary)
    sent = spark.sparkContext.broadcast(model)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        found: Counter = Counter()
        for batch in batches:
            words, weights = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(words), 4096):
                for ids, weight in zip(sp.encode(words[at : at + 4096], num_threads=1), weights[at : at + 4096]):
                    for i in ids:
                        found[i] += weight
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["piece", "n"])

    words = counts.where((F.col("c") > 0) & (F.col("token") != END)).select("token", "c")
    rows = words.mapInArrow(cut, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    seen = {r["piece"]: r["n"] for r in rows}
    ends = counts.where(F.col("token") == END).agg(F.sum("c")).first()[0] or 0
    total = sum(seen.get(i, 0) for i in used) + ends + 0.5 * (len(used) + 1)
    scores: dict[bytes, float] = {}
    for i, piece in used.items():
        p = (seen.get(i, 0) + 0.5) / total
        scores[piece] = p + scores.get(piece, 0.0)  # a byte and the piece of the same one letter
    return Pieces.build({k: math.log(p) for k, p in scores.items()}, math.log((ends + 0.5) / total))


def held_out(id_: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def lattice_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, sent_tokens: int = SENT_TOKENS
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Tokens are the words, lower-cased in A-Z, and an end.  ``base_score`` is the smoothed token model; ``score`` is the
    log10 probability of the words and the end under the lattice over ``vocabulary``, whose piece
    scores come from the training rows.  Each distinct word is run through its lattice once.
    The most frequent ``sent_tokens`` are looked up where the texts are read; a document's other tokens are joined.

    Null text is empty: one token, the end.  Rows with equal ids are scored one by one.  An empty table gives no rows;
    without training rows all tokens are unknown and the pieces are equally likely.  Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), text_of(docs, text_col).alias("text"))
    counts = stored(token_counts(rows), "token-counts")
    total, kinds = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, floor = total or 0, (total or 0) + 0.5 * (kinds + 1)
    model = fit_pieces(spark, counts, vocabulary)

    def marginal(block: dict[str, list]) -> dict[str, list]:
        logs = [model.end if t == END else model.log_probability(t) for t in block["token"]]
        return block | {
            "lp": [x / math.log(10) for x in logs],
            "base": [math.log10((c + 0.5) / floor) for c in block["c"]],
        }

    tokens = map_blocks(counts, marginal, "token string, c bigint, n bigint, lp double, base double", 4096)
    tokens = stored(tokens, "token-scores")
    often = tokens.orderBy(F.col("n").desc(), "token").limit(sent_tokens).collect()
    sent = spark.sparkContext.broadcast({r["token"].encode(): (r["lp"], r["base"], r["c"] > 0) for r in often})

    def near(block: dict[str, list]) -> dict[str, list]:
        get = sent.value.get
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "token", "times")}
        for text in block["text"]:
            words = text.encode().lower().split()
            words.append(b"\n")
            known, base, lp, rest, times = 0, 0.0, 0.0, [], []
            for token, n in Counter(words).items():
                hit = get(token)
                if hit is None:
                    rest.append(token.decode())
                    times.append(n)
                else:
                    lp += n * hit[0]
                    base += n * hit[1]
                    known += n * hit[2]
            for k, v in zip(out, (len(words), known, base, lp, rest, times)):
                out[k].append(v)
        return {"id": block["id"], "held_out": block["held_out"]} | out

    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, token array<string>, times array<bigint>"
    scored = stored(map_blocks(rows, near, schema).withColumn("row", F.monotonically_increasing_id()), "doc-scores")
    rest = scored.select("row", F.explode(F.arrays_zip("token", "times")).alias("t")).select("row", "t.*")
    rest = rest.join(tokens.select("token", "c", "lp", "base"), "token").groupBy("row").agg(
        F.sum(F.col("times") * F.col("lp")).alias("more"), F.sum(F.col("times") * F.col("base")).alias("more_base"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    out = scored.drop("token", "times").join(rest, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select(
        "id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        plus("base_score", "more_base"), plus("score", "more"),
    )
