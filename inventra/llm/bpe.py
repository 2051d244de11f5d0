"""BPE encoding and decoding over a distinct-word table.

Texts are cut at ASCII white space, where the tokenizer's own rules cut as well
(its pre-tokenizer drops white space and no piece spans it).  Blocks send the
buckets each distinct word once; a bucket encodes each of its words once for
the whole corpus and answers with the ids; a block joins the ids back by
position.  Decoding joins ids to the table of pieces, whose size is the fixed
vocabulary's.

A definition for which that doesn't hold is refused: one with a decoder, with
special tokens that touch white space, or whose words may hold white space.

Defined results: a null or empty text has no ids and decodes to an empty text.
A row without doc_id is encoded like any other, and repeated rows each.  Special
tokens' strings in a text are those tokens, as in the library.  An empty table
gives none.  Further columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inventra.llm import blocks as B
from inventra.llm.words import U, join_texts, prefix_hash, span_hash, word_bounds
from inventra.llm.words import _BYTE as _TABLE

#: Bytes of text a block holds; less than elsewhere, as a block's words and
#: their ids and pieces stand in memory as Python objects.
BLOCK_BYTES = 6_000_000
SCHEMA = "doc_id long, ids binary, n_tokens long, decoded string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("decoded", pa.string())])
_loaded: dict[int, object] = {}


def tokenizer_of(definition: str):
    """The library's tokenizer, made once in a worker."""
    import os

    key = hash(definition)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(definition)
        made.no_truncation()
        made.no_padding()
        _loaded[key] = made
    return _loaded[key]


#: Normalizers that turn no letter into white space or back.
_PLAIN = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")


def checked(definition: str) -> str:
    """The definition, if words between white space can be encoded one by one and
    decoding is joining pieces by spaces; else it raises."""
    made = json.loads(definition)

    def flat(part, key):
        return [] if part is None else [x for p in part[key] for x in flat(p, key)] if part["type"] == "Sequence" else [part]

    if made["model"]["type"] != "BPE" or made.get("decoder") is not None:
        raise ValueError("not a BPE definition without a decoder")
    for n in flat(made.get("normalizer"), "normalizers"):
        spaces = n["type"] == "Replace" and n["content"] == " " and n["pattern"] == {"Regex": "\\s+"}
        if n["type"] not in _PLAIN and not spaces:
            raise ValueError(f"normalizer {n['type']} may change where words end")
    first = flat(made.get("pre_tokenizer"), "pretokenizers")[:1]
    drops = bool(first) and (first[0]["type"] in ("Whitespace", "WhitespaceSplit") or (first[0]["type"] == "Split" and first[0]["behavior"] == "Removed" and first[0]["invert"]))
    # What the pattern takes are the words; it must take no white space, alone or beside letters.
    if drops and first[0]["type"] == "Split":
        import regex

        drops = not any(regex.search(r"\s", m) for m in regex.findall(first[0]["pattern"].get("Regex", "."), "a \tb\n1 .\x0b-\x0c'\r c"))
    if not drops:
        raise ValueError("the pre-tokenizer doesn't drop white space")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in made.get("added_tokens", [])):
        raise ValueError("special tokens touch white space")
    return definition


def pieces_of(definition: str) -> list[str]:
    """The piece of each id."""
    vocabulary = tokenizer_of(definition).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = piece
    return out


def _distinct(texts: list[bytes | None]) -> list[bytes]:
    """The block's distinct words in order of first use."""
    seen: dict[bytes, None] = {}
    for t in texts:
        if t:
            seen.update(dict.fromkeys(t.split()))
    return list(seen)


def _buckets(words: list[bytes], n: int):
    data, _ = join_texts(words)
    start, end = word_bounds(data)
    return B.by_bucket(span_hash(prefix_hash(data, _TABLE), start, end) % U(n))


def _ask(n: int):
    def ask(block: int, table: pa.Table):
        _, texts = B.docs_of(table)
        words = _distinct(texts)
        if not words:
            yield block % n, block, 9, B.pack()
            return
        order, cuts = _buckets(words, n)
        for bucket, a, b in cuts:
            yield bucket, block, 0, B.pack(np.frombuffer(b" ".join([words[i] for i in order[a:b].tolist()]), np.uint8))

    return ask


def _answer(definition: str):
    def answer(parts):
        asked = [(block, B.unpack(part)[0].tobytes().split(b" ")) for block, part in parts]
        table = dict.fromkeys(w for _, words in asked for w in words)
        made = tokenizer_of(definition)
        words = list(table)
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            for w, e in zip(some, made.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                table[w] = np.array(e.ids, np.uint32).tobytes()
        for block, own in asked:
            ids = [table[w] for w in own]
            yield block, 1, B.pack(np.array([len(x) // 4 for x in ids], np.uint32), np.frombuffer(b"".join(ids), np.uint32))

    return answer


def _finish(definition: str, n: int):
    pieces = pieces_of(definition)

    def finish(table: pa.Table, parts):
        doc, texts = B.docs_of(table)
        words = _distinct(texts)
        packed, spoken = {}, {}
        told = {bucket: part for bucket, kind, part in parts if kind == 1}
        if words:
            order, cuts = _buckets(words, n)
            for bucket, a, b in cuts:
                size, flat = B.unpack(told[bucket])
                raw, names, at = flat.tobytes(), [pieces[i] for i in flat.tolist()], 0
                for i, many in zip(order[a:b].tolist(), size.tolist(), strict=True):
                    packed[words[i]] = raw[4 * at : 4 * (at + many)]
                    spoken[words[i]] = " ".join(names[at : at + many])
                    at += many
        empty = any(not x for x in packed.values())
        out_ids, out_text = [], []
        for t in texts:
            own = t.split() if t else []
            out_ids.append(b"".join(map(packed.__getitem__, own)))
            said = map(spoken.__getitem__, own)
            out_text.append(" ".join(filter(None, said) if empty else said))
        return doc, out_ids, [len(x) // 4 for x in out_ids], out_text

    return finish


def encode_decode(df: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, decoded:
    one row for each row of ``df``.  ``definition`` is the tokenizer's JSON."""
    checked(definition)
    n = B.pieces(B.total_bytes(df, text), block_bytes)
    docs = B.dealt(df, doc_id, text, n)
    answers = B.answered(B.asked(docs, _ask(n), n), _answer(definition), n)
    return B.met(docs, answers, _finish(definition, n), SCHEMA, _ARROW)
