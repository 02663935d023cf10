"""Fill-in-the-middle: texts cut by token ranks and put together again with the middle last.

Tokens are ``[A-Za-z]+|[^A-Za-z]``. The tokenizers library's Split pre-tokenizer, with its matches isolated, gives
their code-point offsets; nothing is trained. The number of offsets is n, and the offsets at two hashed ranks are the
cuts. White space is a token of its own wherever it stands, so what stands between is given to the pre-tokenizer once
for each distinct word, and a text's offsets are its words' put side by side by numpy. A word longer than ``PIECE``
bytes is cut beside characters that are no letters, where tokens end anyway, so that memory stays bounded.

Only offsets come back from Python: the texts stay with Spark, which cuts, hashes and joins them.

Nulls and odd rows: a null text is empty, and an empty one has no tokens and is plain; a null doc_id hashes as no digits;
rows that repeat a doc_id are cut by the same ranks; an empty table gives no rows; all columns pass through,
and those named n, form, prefix_chars, middle_chars or output are replaced.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, bounded_batches, documents, own_names, text_slices, word_array, word_spans

PATTERN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Percent of documents that stay plain, and of the others percent with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes after which a word is cut at the next place where tokens end.
PIECE = 4096
#: Distinct words whose offsets a worker remembers, and their longest.
WORDS, WORD_BYTES = 200_000, 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_known: dict[bytes, bytes] = {}


@lru_cache(1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(PATTERN), "isolated")


def _ends(word: bytes) -> bytes:
    """Where the tokens of a word end, in code points, as 32-bit integers."""
    found = _known.get(word)
    if found is None:
        found = array("i", [end for _, (_, end) in _splitter().pre_tokenize_str(word.decode())]).tobytes()
        if len(word) <= WORD_BYTES:
            if len(_known) >= WORDS:
                _known.clear()
            _known[word] = found
    return found


def token_ends(buf: np.ndarray, offs: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens end in a slice of texts, in code points from its start, and where each text begins (one more entry at the end)."""
    lead = (buf & 0xC0) != 0x80
    point = np.concatenate([[0], np.cumsum(lead)])  # code points before each byte
    last = np.flatnonzero(~_LETTER[buf] & np.append(lead[1:], True)[: len(buf)])  # last bytes of characters that are no letters
    cuts = last[np.append(False, last[1:] // piece != last[:-1] // piece)[: len(last)]] + 1
    starts, ends, _ = word_spans(buf, np.union1d(offs, cuts))
    words = word_array(buf, starts, ends).dictionary_encode()
    each = [_ends(w) for w in words.dictionary.to_pylist()]
    size = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat = np.frombuffer(b"".join(each), np.int32)
    which = words.indices.to_numpy()
    n = size[which]
    upto = np.cumsum(n) - n
    rel = flat[np.repeat((np.cumsum(size) - size)[which] - upto, n) + np.arange(int(n.sum()))]
    mark = np.zeros(int(point[-1]) + 1, bool)
    mark[np.repeat(point[starts], n) + rel] = True
    mark[point[np.flatnonzero(_SPACE[buf])] + 1] = True
    return np.flatnonzero(mark), point[offs]


def cut_ranks(text: Column, h1: Column, h2: Column) -> Column:
    """struct<n, first, second>: the number of tokens, and the code points before the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) tokens end."""

    @F.arrow_udf("struct<n:long,first:long,second:long>")
    def cut(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        ranks = np.stack([h1.to_numpy(), h2.to_numpy()])
        parts = []
        for lo, hi, buf, offs in text_slices(pa.record_batch([text], names=["text"])):
            ends, begin = token_ends(buf, offs)
            upto = np.searchsorted(ends, begin, "right")
            n = np.diff(upto)
            rank = np.sort(ranks[:, lo:hi] % (n + 1), axis=0)
            full = np.concatenate([ends, [0]])
            parts.append(np.stack([n, *(np.where(r > 0, full[upto[:-1] + r - 1] - begin[:-1], 0) for r in rank)]))
        found = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found], names=["n", "first", "second"])

    return cut(text, h1, h2)


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    mine = own_names(docs, "text", "hash", "cut")
    text, cut = F.col(mine["text"]), F.col(mine["cut"])
    group = lambda i: F.conv(F.substring(F.col(mine["hash"]), 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.withColumn(mine["text"], F.coalesce("text", F.lit(""))).withColumn(mine["hash"], F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    rows = rows.withColumn(mine["cut"], cut_ranks(text, group(0), group(1)))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (group(2) % 100 >= 100 - plain), "plain").when(group(3) % 100 < suffix_first, "spm").otherwise("psm")
    first, second = cut["first"].cast("int"), cut["second"].cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text))
    rows = rows.withColumn("n", cut["n"]).withColumn("form", form)
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    chars = lambda c: F.when(F.col("form") != "plain", c)
    made = rows.withColumns({"prefix_chars": chars(cut["first"]), "middle_chars": chars(cut["second"] - cut["first"]), "output": F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text)})
    return made.drop(*mine.values())


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from. A text with a mark in it is plain, so each mark stands in other outputs once."""
    mark = len(MIDDLE)
    first = lambda m: F.locate(m, output)
    tail = F.substring(output, first(MIDDLE) + mark, F.length(output))
    between = lambda a, b: F.substring(output, first(a) + mark, first(b) - first(a) - mark)
    return F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), tail, between(SUFFIX, MIDDLE))).when(form == "spm", F.concat(between(PREFIX, MIDDLE), tail, between(SUFFIX, PREFIX))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
t as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as l, [('0x' || substr(h, 8 * i + 1, 8))::bigint for i in range(4)] as h from d),
c as (select doc_id, text, l, len(l) as n, h, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) as a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from t),
p as (select doc_id, text, n, form, array_to_string(l[1:a], '') as p, array_to_string(l[a + 1:b], '') as m, array_to_string(l[b + 1:], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256, sha256(text) as restored_sha256 from p
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": ORACLE}
