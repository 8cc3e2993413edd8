"""Token counts by attribution: a document is encoded once as a whole, and its tokens are shared out to its sections.

A byte-level tokenizer's tokens, put together, are the text's bytes, so running sums of token lengths give every token's
byte span, and the bytes that begin a character give its character span. These intervals are joined with the sections'
by binary search. A token that crosses a boundary goes to one section by an explicit rule:

* ``first``: the section of its first character;
* ``last``: the section of its last character;
* ``most``: the section that holds most of its characters, the earlier one at a tie.

Characters outside all sections (separators) form a section of their own, with a null name. So counts always add up to
the document's tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import pieces_of

RULES = ("first", "last", "most")
_ENCODINGS: dict[tuple[str, str], tuple] = {}


def _encoding(path: str, pattern: str):
    """The tokenizer of a ranks file, and each id's length in bytes."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            lengths[number] = len(token)
        enc = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _ENCODINGS[path, pattern] = enc, lengths
    return _ENCODINGS[path, pattern]


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of every token; a token may hold a part of a character."""
    enc, lengths = _encoding(path, pattern)
    ends = np.cumsum(lengths[np.asarray(enc.encode_to_numpy(text, disallowed_special=()), np.int64)])
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return char[starts], char[ends - 1]


def share_out(
    first: np.ndarray, last: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str, owners: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """For each token its section's number, and whether it crosses a boundary.

    Stretches [begin, end) are in order and don't overlap; ``owners`` has the section of each and, last, the number that
    stands for no section. By default every stretch is a section and len(begins) stands for none.
    """
    owners = np.arange(len(begins) + 1) if owners is None else owners
    edges = np.stack([begins, ends], axis=1).ravel()

    def section(at: np.ndarray) -> np.ndarray:
        slot = np.searchsorted(edges, at, side="right")
        return owners[np.where(slot % 2 == 1, slot // 2, len(begins))]

    one, two = section(first), section(last)
    # Between two characters of one gap or section no boundary lies, unless a whole section does.
    crosses = np.searchsorted(edges, first, side="right") != np.searchsorted(edges, last, side="right")
    if rule == "first":
        return one, crosses
    if rule == "last":
        return two, crosses
    out = one.copy()
    for i in np.flatnonzero(crosses):
        own = section(np.arange(first[i], last[i] + 1))
        names, at, n = np.unique(own, return_index=True, return_counts=True)
        out[i] = names[np.lexsort((at, -n))[0]]
    return out, crosses


def attribute_tokens(df: DataFrame, text: str, sections: str, path: str, pattern: str, rule: str = "most") -> DataFrame:
    """One row per row of ``df`` and section: doc_id, section, n_tokens, n_crossing (of them, tokens over a boundary), n_chars.

    ``df`` has doc_id, a text and ``sections``: array of (name, begin, end) in characters. Where
    sections overlap, the innermost one owns a character: the one that begins last, or of those that begin together the
    one that ends first; what lies behind it goes back to the section around it. Sections that share a name are added up. A null text is empty; empty and
    missing sections give rows with 0; the null section comes only where something stands outside. A row is handled in one task.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.string()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("n_chars", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, body, parts in zip(*(pieces_of(batch, c) for c in ("doc_id", "text", "sections"))):
                given = _sections(parts or [], len(body))
                owners, begins, ends = _flat(given)
                names = [name for _, _, name in given]
                first, last = token_spans(body, path, pattern)
                owners = np.array([*owners, len(names)], np.int64)
                own, crosses = share_out(first, last, begins, ends, rule, owners)
                tokens = np.bincount(own, minlength=len(names) + 1)
                over = np.bincount(own, crosses, minlength=len(names) + 1)
                chars = np.bincount(owners[:-1], ends - begins, len(names) + 1)
                chars[-1] = len(body) - (ends - begins).sum()
                sums: dict = {}
                for i, name in enumerate([*names, None]):
                    if i == len(names) and not tokens[i] and not chars[i]:
                        continue
                    a = sums.setdefault(name, [0, 0, 0])
                    a[0] += int(tokens[i])
                    a[1] += int(over[i])
                    a[2] += int(chars[i])
                out += [(doc, name, *a) for name, a in sums.items()]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    read = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col(sections).cast("array<struct<name:string,begin:int,end:int>>").alias("sections"),
    )
    return read.mapInArrow(count, "doc_id long, section string, n_tokens long, n_crossing long, n_chars long")


def _sections(parts: list[dict], n: int) -> list[tuple[int, int, str]]:
    """(begin, end, name) within the text's n characters; a section around another comes before it."""
    whole = [(min(n, max(0, p["begin"])), min(n, p["end"]), p["name"]) for p in parts if p and None not in (p["name"], p["begin"], p["end"])]
    return sorted(((b, max(b, e), name) for b, e, name in whole), key=lambda s: (s[0], -s[1], s[2]))


def _flat(sections: list[tuple[int, int, str]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Stretches that don't overlap, in order: the number of the innermost section over each, its begin and its end."""
    out: list[list[int]] = []
    open_: list[int] = []

    def put(owner: int, begin: int, end: int) -> None:
        if begin < end:
            out.append([owner, begin, end])

    at = 0
    for i, (begin, _, _) in [*enumerate(sections), (-1, (1 << 62, 0, ""))]:
        # Sections that end before this one begins give way to those around them.
        while open_ and at < begin:
            inner = open_[-1]
            end = min(sections[inner][1], begin)
            put(inner, at, end)
            at = max(at, end)
            if sections[inner][1] <= begin:
                open_.pop()
        at = max(at, begin)
        open_.append(i)
    cells = np.array(out, np.int64).reshape(-1, 3)
    return cells[:, 0].tolist(), cells[:, 1], cells[:, 2]


def record_with_sections(df: DataFrame, fields: Sequence[str], separator: str = " ") -> DataFrame:
    """doc_id, record (the fields' texts joined by ``separator``; null is empty) and sections (each field's span in it)."""
    texts = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    at: Column = F.lit(0)
    spans = []
    for name, text in zip(fields, texts):
        end = at + F.char_length(text)
        spans.append(F.struct(F.lit(name).alias("name"), at.alias("begin"), end.alias("end")))
        at = end + len(separator)
    return df.select("doc_id", F.concat_ws(separator, *texts).alias("record"), F.array(*spans).alias("sections"))
