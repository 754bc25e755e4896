"""Token ids and token counts of whole texts, as the tokenizers library gives them.

Both functions use what is provable about their vocabulary's splitting rule, so that a word met before is not encoded
again; a worker keeps the ids of up to ``MEMO`` words. ``count_tokens`` cuts huge texts into overlapping chunks and splices
the encodings at stable common boundaries.

Null texts count as empty, and an empty table gives an empty result. Repeated rows are encoded one by one; other columns
aren't read. The vocabulary file is a parameter (a path that every
executor has).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import require

MEMO = 600_000
#: Bytes of texts that are cut into words at once, so that a batch's words aren't all held as objects.
RUN = 1 << 20
#: Texts over so many code points are encoded in overlapping chunks of so many, with so much overlap at first.
CHUNK, OVERLAP = 32_768, 256

_open: dict[str, object] = {}
_memos: dict[tuple[str, str], dict] = {}


def vocabulary(path: str):
    """The tokenizer of a worker, read once; its own threads are off, since Spark runs a task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _open:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _open[path] = tokenizer
    return _open[path]


# Fixed value: the byte-level vocabulary's splitting rule.
BYTE_LEVEL_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merger(path: str):
    """The byte-level vocabulary of a tokenizers file as a tiktoken encoding, which merges faster.

    Ids of this vocabulary are in the order of its merges and every token encodes to itself (tests prove both), so both
    libraries give the same ids for a part of a text that the rule cuts alike.
    """
    import tiktoken

    key = f"{path}#ranks"
    if key not in _open:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ordinary = vocabulary(path).get_vocab(with_added_tokens=False)
        special = {t.content for t in vocabulary(path).get_added_tokens_decoder().values()}
        ranks = {bytes(shown[c] for c in token): i for token, i in ordinary.items() if token not in special}
        _open[key] = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_RULE, mergeable_ranks=ranks, special_tokens={})
    return _open[key]


# Normalizer and splitting rule of the vocabularies that the shortcuts below are proven for.
SPLITTING = {
    "bytes": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "words": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
}


def splits_by(path: str, rule: str) -> bool:
    """Whether a vocabulary splits texts by one of the rules in ``SPLITTING`` and its special strings begin with ``<|``. Texts of
    any other vocabulary are encoded whole."""
    key = f"{path}#{rule}"
    if key not in _open:
        told = json.loads(vocabulary(path).to_str())
        plain = all(t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) for t in told["added_tokens"])
        _open[key] = plain and (told["normalizer"], told["pre_tokenizer"]) == SPLITTING[rule]
    return _open[key]


def _memo(path: str, kind: str) -> dict:
    memo = _memos.setdefault((path, kind), {})
    if len(memo) > MEMO:
        memo.clear()
    return memo


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in pc.cast(column, pa.large_binary()).to_pylist()]


def _runs(texts: list[bytes]) -> Iterator[list[bytes]]:
    """``texts`` in order, in runs of about ``RUN`` bytes."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= RUN:
            yield run
            run, size = [], 0
    if run:
        yield run


def _stable(text: str, at: int) -> bool:
    """Nothing left of ``at`` can change the tokens right of it: the rule of this vocabulary drops white space, joins
    nothing across it, and no normalisation composes with it."""
    return text[at - 1] in " \t\n\x0b\x0c\r"


def spliced_count(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` from overlapping chunks; ``encode`` gives an encoding with offsets in code points.

    Two neighbours are joined at a place inside their overlap where both begin a token and which is stable. Where there
    is none, the overlap is widened to twice its width, up to the whole left chunk and beyond its end.
    """
    size, total, begin = len(text), 0, 0  # tokens before the boundary ``begin`` are counted
    while True:
        end = min(size, begin + chunk)
        left = [a for a, _ in encode(text[begin:end]).offsets]
        if end == size:
            return total + len(left)
        width, found = overlap, None
        while found is None:
            start = max(begin + 1, end - width)
            stop = min(size, end + width)
            right = {a + start for a, _ in encode(text[start:stop]).offsets}
            common = [a + begin for a in left if a + begin > start and a + begin in right and _stable(text, a + begin)]
            if common:
                found = common[-1]
            elif start == begin + 1:  # the whole chunk has no stable boundary: take a longer one
                chunk *= 2
                break
            else:
                width *= 2
        if found is not None:
            total += sum(1 for a in left if a + begin < found)
            begin = found


def count_tokens(documents: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns, n_bytes and n_tokens of every text, for the vocabulary whose words end at white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = vocabulary(path)
        encode = lambda x: tokenizer.encode(x, add_special_tokens=False)
        shortcut = splits_by(path, "words")
        for batch in batches:
            texts, counts = _bytes(batch.column(text)), []
            for run in _runs(texts):
                memo = _memo(path, "count")
                split = [x.split() if shortcut and len(x) <= CHUNK else None for x in run]
                new = list(set().union(*[x for x in split if x]).difference(memo))
                for i in range(0, len(new), 4096):
                    part = new[i : i + 4096]
                    memo.update(zip(part, map(len, tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False))))
                known = memo.__getitem__
                counts += [sum(map(known, w)) if w is not None else spliced_count(x.decode(), encode) if shortcut else len(encode(x.decode()).ids) for w, x in zip(split, run)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array([len(x) for x in texts], pa.int64()), pa.array(counts, pa.int64())], names=[*keys, "n_bytes", "n_tokens"])

    rows = require(documents, *keys, text)
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys])
    return rows.mapInArrow(run, f"{schema}, n_bytes long, n_tokens long")


def encode_all(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, for the byte-level vocabulary with leading blanks.

    Its rule joins one blank to the word behind it, so a text falls apart before each single blank that a word follows:
    these parts are encoded once each, by ``merger`` where they hold only characters below U+0250 and no special string
    can begin in them. A part that begins with more white space depends on what stands before it; texts
    with such a part are encoded whole.
    """
    for run in _runs(texts):
        if splits_by(path, "bytes"):
            yield from _encode_run(run, path)
        else:
            yield from (np.asarray(e.ids, dtype="<u4").tobytes() for e in vocabulary(path).encode_batch_fast([x.decode() for x in run], add_special_tokens=False))


def _encode_run(texts: list[bytes], path: str) -> list[bytes]:
    tokenizer, merge = vocabulary(path), merger(path).encode_ordinary
    pack = lambda e: np.asarray(e.ids, dtype="<u4").tobytes()
    first, rest = _memo(path, "first"), _memo(path, "rest")
    split = [x.split(b" ") for x in texts]
    for memo, lead, new in ((first, "", {x[0] for x in split}.difference(first)), (rest, " ", set().union(*[x[1:] for x in split]).difference(rest))):
        todo = []
        for word in new:
            shown = word.decode()
            if lead and (not shown or shown[0].isspace()):
                memo[word] = None
            elif "<|" in shown or not (shown.isascii() or max(shown) < "\u0250"):
                todo.append(word)
            else:
                memo[word] = np.asarray(merge(lead + shown), dtype="<u4").tobytes()
        for i in range(0, len(todo), 4096):
            part = todo[i : i + 4096]
            memo.update(zip(part, map(pack, tokenizer.encode_batch_fast([lead + x.decode() for x in part], add_special_tokens=False))))
    out = []
    for text, parts in zip(texts, split):
        ids = list(map(rest.__getitem__, parts[1:]))
        if None in ids:
            out.append(pack(tokenizer.encode(text.decode(), add_special_tokens=False)))
        else:
            out.append(first[parts[0]] + b"".join(ids))
    return out
