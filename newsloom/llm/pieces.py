"""Problem 10: cutting oversized documents at natural boundaries by packing their structure tree."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.bpe import TOKENIZER_DIR, VOCABULARY, PrefixEncoder, load_vocabulary, worker_encoder

_HEADING = re.compile(r"(#{1,6})\s|(section|article|chapter|part|title)\s+[\w.,-]+", re.I)
_TAG_HEADING = re.compile(r"<h([1-6])\b", re.I)
_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)]|\([a-z0-9]{1,3}\))\s")
_ROW = re.compile(r"\s*\|")
_SENTENCE = re.compile(r"""[.!?…]["'”’)\]]*(?=\s)""")


@dataclass
class Node:
    """A range of characters; its children, if any, tile it."""

    start: int
    end: int
    children: list[Node] = field(default_factory=list)


def _group(nodes: list[Node]) -> Node:
    return Node(nodes[0].start, nodes[-1].end, nodes)


def _level(line: str) -> int:
    """Depth of a heading line (1 the highest), 0 for any other line."""
    stripped = line.strip()
    if not stripped or len(stripped) > 200:
        return 0
    m = _HEADING.match(stripped)
    if m and m.group(1):
        return len(m.group(1))
    if m and len(stripped) <= 80:
        return 2
    m = _TAG_HEADING.match(stripped)
    return int(m.group(1)) if m else 0


def parse(text: str) -> Node:
    """Document -> sections (nested by heading level) -> blocks (paragraph, list, table) -> lines."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, at + len(line), line))
        at += len(line)
    # blocks: lines of one kind without a blank line between; a blank line belongs to the block before it
    blocks: list[tuple[int, str, list[Node]]] = []
    kind_before, blank = "", True
    for s, e, line in lines:
        if not line.strip():
            if blocks:
                tail = blocks[-1][2][-1]
                tail.end = e
            else:
                blocks.append((0, "text", [Node(s, e)]))
            blank = True
            continue
        level = _level(line)
        kind = "heading" if level else "list" if _ITEM.match(line) else "table" if _ROW.match(line) else "text"
        if blocks and not blank and kind == kind_before and not level:
            blocks[-1][2].append(Node(s, e))
        else:
            blocks.append((level, kind, [Node(s, e)]))
        kind_before, blank = kind, False
    root: list[Node] = []
    open_sections: list[tuple[int, list[Node]]] = [(0, root)]
    closed: list[tuple[list[Node], list[Node]]] = []
    for level, _, parts in blocks:
        node = _group(parts) if len(parts) > 1 else parts[0]
        if level:
            while open_sections[-1][0] >= level:
                open_sections.pop()
            section: list[Node] = [node]
            holder = Node(node.start, node.end, section)
            open_sections[-1][1].append(holder)
            open_sections.append((level, section))
            closed.append((section, [holder]))
        else:
            open_sections[-1][1].append(node)
    for section, (holder,) in reversed(closed):  # inner sections first
        holder.end = section[-1].end
        if len(section) == 1:
            holder.children = section[0].children
    return Node(0, len(text), root)


def _sentences(text: str, node: Node) -> list[Node]:
    cuts = [node.start, *(m.end() for m in _SENTENCE.finditer(text, node.start, node.end) if m.end() < node.end), node.end]
    return [Node(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


class Splitter:
    def __init__(self, encoder: PrefixEncoder, limit: int = 512, overlap: int = 64):
        if not 0 <= overlap < limit:
            raise ValueError("overlap must be at least 0 and below the limit")
        self.encoder, self.limit, self.overlap = encoder, limit, overlap

    def _index(self, text: str) -> None:
        """Character starts of all pre-tokens and the tokens before each; long pre-tokens are opened up."""
        self.starts, self.before, total = [], [], 0
        for m in self.encoder.finditer(text):
            word = m.group()
            n = len(self.encoder.encode_word(word))
            if n <= self.limit - self.overlap:
                self.starts.append(m.start())
                self.before.append(total)
                total += n
            else:  # cut points inside, every few characters; counts are those of the parts
                step = max(1, (self.limit - self.overlap) // 16)
                for i in range(0, len(word), step):
                    self.starts.append(m.start() + i)
                    self.before.append(total)
                    total += len(self.encoder.encode_word(word[i : i + step]))
        self.starts.append(len(text))
        self.before.append(total)

    def _snap(self, at: int) -> int:
        """The last pre-token start at or before ``at``."""
        return self.starts[bisect_right(self.starts, at) - 1]

    def _count(self, start: int, end: int) -> int:
        return self.before[bisect_left(self.starts, end)] - self.before[bisect_left(self.starts, start)]

    def _units(self, text: str, node: Node, out: list[tuple[int, int]], capacity: int) -> None:
        """Bottom-up packing: siblings are merged while they fit; only a node that doesn't fit is descended into."""
        children = node.children
        if not children:
            children = _sentences(text, node)
            if len(children) < 2:  # one sentence: its words
                i, j = bisect_left(self.starts, node.start), bisect_left(self.starts, node.end)
                children = [Node(a, b) for a, b in zip(self.starts[i:j], self.starts[i + 1 : j + 1])]
        open_start = open_end = None
        for child in children:
            a, b = self._snap(child.start), self._snap(child.end)
            if a >= b:
                continue
            if self._count(a, b) > capacity:
                if open_start is not None:
                    out.append((open_start, open_end))
                    open_start = None
                self._units(text, Node(a, b, child.children), out, capacity)
            elif open_start is not None and self._count(open_start, b) <= capacity:
                open_end = b
            else:
                if open_start is not None:
                    out.append((open_start, open_end))
                open_start, open_end = a, b
        if open_start is not None:
            out.append((open_start, open_end))

    def _overlap_start(self, text: str, low: int, end: int) -> int:
        """Where the repeat before ``end`` begins: a sentence start if one lies within reach, else a word start."""
        j = bisect_left(self.starts, end)
        i = bisect_left(self.before, self.before[j] - self.overlap, 0, j + 1)
        start = max(self.starts[i], low)
        while start < end and len(self.encoder.encode(text[start:end])) > self.overlap:
            start = self.starts[bisect_right(self.starts, start)]
        if start >= end:
            return end
        for m in _SENTENCE.finditer(text, start, end):
            if m.end() < end and text[m.end() : end].strip():
                return self._snap(m.end()) if self._snap(m.end()) >= start else start
        return start

    def split(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(start, own_start, end, tokens) of each piece; [start, own_start) repeats the piece before.

        Empty if the text has at most ``limit`` tokens. The own ranges tile the text.
        """
        if not text or len(text.encode("utf-8", "replace")) <= self.limit or len(self.encoder.encode(text)) <= self.limit:
            return []
        self._index(text)
        units: list[tuple[int, int]] = []
        self._units(text, parse(text), units, self.limit - self.overlap)
        out: list[tuple[int, int, int, int]] = []
        todo = units[::-1]
        while todo:
            own, end = todo.pop()
            start = self._overlap_start(text, out[-1][0], own) if out and self.overlap else own
            tokens = len(self.encoder.encode(text[start:end]))
            while tokens > self.limit and start < own:  # counts at cut ends may differ by a token or two
                start = self.starts[bisect_right(self.starts, start)]
                tokens = len(self.encoder.encode(text[start:end]))
            if tokens > self.limit and end - own > 1:
                half = self._snap((own + end) // 2)
                half = half if own < half < end else (own + end) // 2
                todo += [(half, end), (own, half)]
                continue
            out.append((start, own, end, tokens))
        return out


def split_oversized(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    overlap: int = 64,
    tokenizer_dir: str = TOKENIZER_DIR,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(id_col, piece_no, start_char, own_start_char, end_char, n_tokens, piece) of every text of more than ``limit`` tokens.

    A text is parsed into a tree of headings, lists, tables, paragraphs and lines; sibling subtrees are merged up to
    ``limit - overlap`` tokens and only oversized nodes are opened, down to sentences, words and at last characters of a
    run without any space. Each piece but the first repeats up to ``overlap`` tokens from the end of the piece before,
    from a sentence start where one is in reach. Own parts (from own_start_char) joined in order give the text again.
    Texts within the limit, empty and null texts give no rows; repeated rows are cut alike; other columns are ignored.
    Map-only: no shuffle; memory holds one Arrow batch and one text.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_dir, vocabulary))
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["id", "piece_no", "start_char", "own_start_char", "end_char", "n_tokens", "piece"]

    def run(batches):
        splitter = Splitter(worker_encoder(f"{tokenizer_dir}/{vocabulary}", shared), limit, overlap)
        for b in batches:
            rows, numbers, pieces = [], [[], [], [], [], []], []
            for r, text in enumerate(b.column(1).to_pylist()):
                for no, (start, own, end, tokens) in enumerate(splitter.split(text)):
                    rows.append(r)
                    for column, x in zip(numbers, (no, start, own, end, tokens)):
                        column.append(x)
                    pieces.append(text[start:end])
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int32()) for x in numbers], pa.array(pieces, pa.string())], names)

    return (
        df.select(df[id_col].alias("id"), df[text_col].alias("text"))
        .mapInArrow(run, f"id {id_type}, piece_no int, start_char int, own_start_char int, end_char int, n_tokens int, piece string")
        .withColumnRenamed("id", id_col)
    )
