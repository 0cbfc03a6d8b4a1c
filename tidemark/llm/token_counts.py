"""Token counts by trie-shared dynamic programming over a unigram vocabulary."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

#: Stands for the space before a pre-token.
SPACE = "▁"
#: Trie nodes and terminal counts that a worker keeps; beyond either it starts a new trie. The
#: counts of the trie before stay at hand, so that frequent pre-tokens aren't scored again.
NODES, WORDS = 400_000, 200_000
#: Pre-tokens longer than this are scored alone and not kept.
LONG = 200


class UnigramTrie:
    """Best unigram segmentation of pre-tokens, its forward scores kept at the trie's nodes.

    A node stands for a prefix. Its forward score is the best sum of piece scores over ways to cut
    the prefix into pieces, with the number of tokens of that cut (the fewer, if two are as good).
    All pre-tokens with a prefix in common use its score once computed. The pieces that end at a
    node are known from a state of an Aho-Corasick automaton over all pieces, kept at the node. A
    character that no piece holds costs a token for each UTF-8 byte, ``byte_score`` each.
    """

    def __init__(self, pieces: dict[str, float], byte_score: float):
        self.pieces, self.byte_score = pieces, byte_score
        self._automaton()
        self.terminal: dict[str, int] = {}
        self.clear()

    def _automaton(self) -> None:
        step: dict[tuple[int, str], int] = {}
        ends: list[tuple[tuple[int, float], ...]] = [()]
        below: list[list[tuple[str, int]]] = [[]]
        for piece, score in self.pieces.items():
            at = 0
            for ch in piece:
                to = step.get((at, ch))
                if to is None:
                    to = step[at, ch] = len(ends)
                    ends.append(())
                    below.append([])
                    below[at].append((ch, to))
                at = to
            ends[at] = ((len(piece), score),)
        fail, queue = [0] * len(ends), [to for _, to in below[0]]
        for at in queue:  # by depth: what a state falls back to is done before it
            ends[at] += ends[fail[at]]
            for ch, to in below[at]:
                back = fail[at]
                while back and (back, ch) not in step:
                    back = fail[back]
                fail[to] = step.get((back, ch), 0)
                queue.append(to)
        self.step, self.fail, self.ends = step, fail, ends

    def _state(self, at: int, ch: str) -> int:
        step, fail = self.step, self.fail
        while (to := step.get((at, ch))) is None:
            if not at:
                return 0
            at = fail[at]
        return to

    def clear(self) -> None:
        """Start a new trie; the counts of the one before are kept until the next."""
        self.before = self.terminal
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens, self.state = [0.0], [0], [0]
        self.terminal = {}

    def _forward(self, s: str, d: int, state: int, path, score: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of s[:d], from those of the shorter prefixes along ``path``."""
        ends = self.ends[state]
        if ends and ends[-1][0] == 1:
            best, count = -1e300, 0
        else:
            n_bytes = len(s[d - 1].encode("utf-8", "replace"))
            before = path[d - 1]
            best, count = score[before] + n_bytes * self.byte_score, tokens[before] + n_bytes
        for length, p in ends:
            before = path[d - length]
            total = score[before] + p
            if total > best or (total == best and tokens[before] + 1 < count):
                best, count = total, tokens[before] + 1
        return best, count

    def count(self, word: str) -> int:
        """Tokens of the pre-token ``word``, a space before it."""
        if (known := self.terminal.get(word)) is not None:
            return known
        if (known := self.before.get(word)) is not None:
            self.terminal[word] = known
            return known
        s, state = SPACE + word, 0
        if len(word) > LONG:
            score, tokens = [0.0], [0]
            path = range(len(s) + 1)
            for d, ch in enumerate(s, 1):
                state = self._state(state, ch)
                a, b = self._forward(s, d, state, path, score, tokens)
                score.append(a)
                tokens.append(b)
            return tokens[-1]
        if len(self.score) > NODES or len(self.terminal) > WORDS:
            self.clear()
        child, score, tokens, states = self.child, self.score, self.tokens, self.state
        node, path = 0, [0]
        for d, ch in enumerate(s, 1):
            if (to := child.get((node, ch))) is None:
                state = self._state(states[node], ch)
                a, b = self._forward(s, d, state, path, score, tokens)
                to = child[node, ch] = len(score)
                score.append(a)
                tokens.append(b)
                states.append(state)
            path.append(to)
            node = to
        self.terminal[word] = tokens[node]
        return tokens[node]


@lru_cache(maxsize=2)
def load(path: str) -> UnigramTrie:
    """Pieces of a sentencepiece file as a unigram vocabulary. The file has ranks, not
    probabilities, so piece r (from 0) gets Zipf's log-probability -ln(r + 1) - ln(H), where H is
    the sum of 1/(r + 1); a byte costs ten less than the rarest piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(names))))
    pieces = {p: -math.log(r + 1) - norm for r, p in enumerate(names)}
    return UnigramTrie(pieces, min(pieces.values()) - 10)


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words and n_tokens (long) for every whole text.

    Pre-tokens are the runs between white space, each with a space put before it. Null and empty
    texts have 0 of both; repeated rows stay; clashing columns are replaced; an empty table gives
    no rows. No shuffle: each worker keeps a bounded trie between batches and tasks.
    """

    def make():
        trie = load(path)

        def do(texts: list[bytes | None]) -> list[list]:
            words, tokens = [], []
            for t in texts:
                split = t.decode("utf-8", "replace").split() if t else []
                known, count = trie.terminal.get, trie.count
                words.append(len(split))
                tokens.append(sum([known(w) or count(w) for w in split]))
            return [words, tokens]

        return do

    return map_text(df, text, [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())], make, keep)
