"""A score of abusive, hateful or sexually explicit language for every document."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovewise.storage import Scratch

# Words that name groups of people in general; names of a corpus of its own are learned (``group_names``).
IDENTITIES = (
    "women", "men", "girls", "foreigners", "immigrants", "refugees", "Jews", "Muslims", "Christians", "gays", "lesbians", "Blacks",
    "Asians", "Roma", "Frauen", "Ausländer", "femmes", "étrangers", "mujeres", "extranjeros", "mulheres", "estrangeiros",
)
# Letters of other scripts that look like Latin ones, and signs that stand for letters within a word.
_LOOKALIKES = dict(zip("аеорсхуіѕјкмтнвһԁɡοαεικνρτυχӏßøłđæœı", "aeopcxyisjkmthbhdgoaeikvptuxlsoldaoi"))
_SIGNS = dict(zip("0134578@$", "oieastbas"))
#: Neutral words that a group's name is also exchanged for.
NEUTRAL = ("students", "authors", "residents", "readers")
# Words before the name of a group, of languages that write common nouns small.
_BEFORE = ("the", "all", "those", "these", "every", "against", "about", "without", "few", "many", "most", "les", "tous", "ces", "contre", "sans", "los", "todos", "estos", "contra", "sin", "os", "estes", "sem")

_WIDTH = 0x1E000
BITS = 20
_DELETE, _GAP, _STOP, _MASK = 0, 32, 46, 123


def _fold_table() -> np.ndarray:
    """For each code point a Latin letter or digit, a gap, a stop, or nothing."""
    table = np.full(_WIDTH, _GAP, np.uint8)
    for point in range(_WIDTH):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind in ("Mn", "Cf", "Me") or c in "\xad_":
            table[point] = _DELETE
        elif c in ".!?…。":
            table[point] = _STOP
        elif c in "@$*":
            table[point] = point
        elif kind[0] in "LN":
            low = c.lower()
            base = _LOOKALIKES.get(low) or unicodedata.normalize("NFKD", low)[0].lower()
            base = _LOOKALIKES.get(base, base)
            if base.isascii() and base.isalnum():
                table[point] = ord(base)
    return table


# markup inside words: emphasis, accents, empty groups, optional hyphens
_MARKUP = re.compile(
    r"\\(?:textbf|textit|textsc|textrm|textsf|texttt|emph|underline|mbox|uppercase|lowercase)\{([^{}]*)\}"
    r"|\\[\"'`^~=.]\{?\\?([A-Za-z])\}?|\\[cvuHkbdr]\{\\?([A-Za-z])\}|\\-|\\/|\\,|\{\}|\\allowbreak\b ?|\\relax\b ?|\\null\b ?"
)
_BREAKS = re.compile(r"\n[ \t%]*\n|\n[ \t%]*\\|\\(?:footnote|section|item|title|caption|iffalse|fi|def|newcommand|todo)\b|\\(?:begin|end)\{[^{}]*\}|\\\]|\$\$|%%+")
_tables: list[np.ndarray] = []
_SIGN_TABLE = np.arange(256, dtype=np.uint8)
for _c, _to in _SIGNS.items():
    _SIGN_TABLE[ord(_c)] = ord(_to)
_SIGN_TABLE[[50, 54, 57]] = ord("z"), ord("g"), ord("g")


def _unbroken(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _BREAKS.sub(" .\n", _MARKUP.sub(r"\1\2\3", text))


def _drop(codes: np.ndarray, text_of: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = ~gone
    return codes[keep], text_of[keep]


@dataclass
class Passages:
    """The passages of some texts: each ``word`` (a hash) with its passage, each passage's ``text``, and the
    words' and neighbouring words' ``feature`` with its ``passage``."""

    word: np.ndarray
    word_of: np.ndarray
    text: np.ndarray
    feature: np.ndarray
    passage: np.ndarray

    @property
    def n(self) -> int:
        return len(self.text)


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _M3
    return ((x ^ x >> np.uint64(29)) * _M1 >> np.uint64(64 - BITS)).astype(np.int64)


def _featured(word: np.ndarray, word_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of words and of neighbouring words of a passage, and the passage of each."""
    pair = word[1:] * _M2 + word[:-1] * _M3
    inside = word_of[1:] == word_of[:-1]
    return np.concatenate([_mixed(word), _mixed(pair[inside])]), np.concatenate([word_of, word_of[1:][inside]])


def passages(texts: list[str]) -> Passages:
    """Words and neighbouring words, hashed, of each passage.

    Disguises are undone first: markup inside words, characters without width, look-alike letters, signs
    for letters, letters repeated three times or more, letters set apart one by one, and line breaks with
    comment signs. A passage ends at a stop, an empty line or a structural command.
    """
    if not _tables:
        _tables.append(_fold_table())
    plain = [_unbroken(t) + "\n.\n" for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in plain])
    codes = _tables[0][np.minimum(codes, _WIDTH - 1)]
    codes, text_of = _drop(codes, text_of, codes == _DELETE)
    letter = (codes >= 97) & (codes <= 122)
    digit = (codes >= 48) & (codes <= 57)
    edge = np.flatnonzero(np.diff(np.r_[False, letter | digit, False].astype(np.int8)))
    worded = np.add.reduceat(np.r_[letter, False].astype(np.int32), edge)[::2] > 0 if len(edge) else edge
    for_letter = np.repeat(worded, (edge[1::2] - edge[::2]))
    at = np.flatnonzero(letter | digit)[for_letter]
    at = at[digit[at]]
    codes[at], letter[at] = _SIGN_TABLE[codes[at]], True
    letter = (codes >= 97) & (codes <= 122)
    inside = np.flatnonzero((codes == 36) | (codes == 42) | (codes == 64))
    inside = inside[(inside > 0) & (inside < len(codes) - 1)]
    star = codes[inside] == 42
    # a sign stands for a letter between letters; stars mask any number of letters
    plain = inside[~star]
    plain = plain[letter[plain - 1] & letter[plain + 1]]
    codes[plain] = _SIGN_TABLE[codes[plain]]
    stars = codes == 42
    edge = np.flatnonzero(np.diff(np.r_[False, stars, False].astype(np.int8)))
    if len(edge):
        begin, end = edge[::2], edge[1::2]
        masks = (begin > 0) & letter[np.maximum(begin - 1, 0)] & letter[np.minimum(end, len(codes) - 1)]
        for b_, e_ in zip(begin[masks], end[masks]):
            codes[b_:e_] = _MASK
    letter = (codes >= 97) & (codes <= _MASK)
    same = np.r_[False, codes[1:] == codes[:-1]] & letter
    longer = np.r_[same[1:], False]
    codes, text_of = _drop(codes, text_of, same & (np.r_[False, same[:-1]] | longer))
    letter = (codes >= 97) & (codes <= _MASK)
    # letters set apart: at least three single letters in a row with one character between
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    near = (end - begin == 1)[:-1] & (end - begin == 1)[1:] & (begin[1:] - begin[:-1] == 2)
    run = near & (np.r_[False, near[:-1]] | np.r_[near[1:], False]) if len(near) else near
    gone = np.zeros(len(codes), bool)
    gone[begin[:-1][run] + 1] = True
    codes, text_of = _drop(codes, text_of, gone)
    letter = (codes >= 97) & (codes <= _MASK)
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    stop = (codes == _STOP) & ~np.r_[letter[1:], False]
    number = np.cumsum(stop)
    size = end - begin
    raw = codes.tobytes() + bytes(16)
    words = np.ndarray((len(codes) + 9,), "<u8", raw, strides=(1,))
    word = (words[begin] & _MASKS[np.minimum(size, 8)]) * _M1 ^ (words[np.minimum(begin + 8, len(codes))] & _MASKS[np.clip(size - 8, 0, 8)]) * _M2 ^ size.astype(np.uint64)
    long = np.flatnonzero(size > 16)
    word[long] ^= words[end[long] - 8] * _M3
    word ^= word >> np.uint64(31)
    masked = np.flatnonzero(codes == _MASK)
    word[np.searchsorted(begin, masked, "right") - 1] = _M2  # any masked word
    at = number[begin] if len(begin) else np.zeros(0, np.int64)
    new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    word_of = np.cumsum(new) - 1
    return Passages(word, word_of, text_of[begin[new]] if len(begin) else np.zeros(0, np.int32), *_featured(word, word_of))


def _sums(feature: np.ndarray, passage: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(passage, weights[feature], n)


def _rows(feature: np.ndarray, passage: np.ndarray, n: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some of ``n`` passages, numbered as in ``ids``."""
    number = np.full(n, -1)
    number[ids] = np.arange(len(ids))
    row = number[passage]
    take = row >= 0
    return row[take], feature[take]


def text_scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The score of each text's worst passage, between 0 and 1; 0 for a text without words."""
    p = passages(texts)
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, p.text, _sums(p.feature, p.passage, p.n, weights) + weights[-1])
    return np.where(worst == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(worst, -700, 50))))


def group_names(texts: list[str], least: int = 2) -> list[str]:
    """Names of groups that the texts use: capitalised words in at least ``least`` texts, after at least
    ``least`` different words of ``_BEFORE`` ("the", "all", "against", ...), that also occur in no text in small
    letters after one of these."""
    pattern = re.compile(r"\b(%s)\s+([^\W\d_]{3,})\s+(?=[^\W\d_])" % "|".join(_BEFORE), re.I)
    seen: dict[str, tuple[set[int], set[str]]] = {}
    small: set[str] = set()
    for i, text in enumerate(texts):
        for before, word in pattern.findall(text):
            if word[0].isupper() and word[1:].islower():
                held = seen.setdefault(word, (set(), set()))
                held[0].add(i)
                held[1].add(before.lower())
            else:
                small.add(word.capitalize())
    return sorted(w for w, (where, before) in seen.items() if min(len(where), len(before)) >= least and w not in small)


@dataclass
class Examples:
    """Passages of labelled texts, with a 64-bit hash of each one's words in order (``content``), and twins.

    ``twin`` holds the features of passages with their groups' names exchanged, ``twin_of`` the passage
    that each belongs to. Every passage that names a group has a twin.
    """

    feature: np.ndarray
    passage: np.ndarray
    text: np.ndarray
    content: np.ndarray
    twin: np.ndarray
    twin_of: np.ndarray

    @property
    def n(self) -> int:
        return len(self.text)

    @cached_property
    def held(self) -> np.ndarray:
        """Each feature of each text, once: the feature in the upper 32 bits, the text in the lower."""
        return np.unique(self.feature.astype(np.int64) << 32 | self.text[self.passage])


def _content(p: Passages) -> np.ndarray:
    first = np.flatnonzero(np.r_[True, p.word_of[1:] != p.word_of[:-1]]) if len(p.word) else np.zeros(0, np.int64)
    place = (np.arange(len(p.word)) - first[p.word_of]).astype(np.uint64) if len(p.word) else p.word
    x = (p.word ^ place * _M1) * _M2
    x = (x ^ x >> np.uint64(32)) * _M3
    return np.add.reduceat(x ^ x >> np.uint64(29), first) if len(first) else np.zeros(0, np.uint64)


def examples(texts: list[str], names: list[str], chunk: int = 200) -> Examples:
    """Passages of ``texts``, a chunk at a time, each with its twin where it names a group.

    A name is exchanged for the next one of the list or a neutral word, within the passage's words, so the
    cutting into passages stays as it is and no twin is lost.
    """
    own = [passages([name]).word[:1] for name in [*names, *NEUTRAL]]
    hashes = np.concatenate([*own, np.zeros(0, np.uint64)])
    n = len(hashes) - len(NEUTRAL)
    to = np.array([hashes[n + k // 2 % len(NEUTRAL)] if k % 2 or n < 2 else hashes[(k + 1) % n] for k in range(n)], np.uint64)
    order = np.argsort(hashes[:n], kind="stable")
    known, to = hashes[:n][order], to[order]
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] * 3 + [np.zeros(0, np.uint64)] + [np.zeros(0, np.int32)] * 2]
    before = 0
    for at in range(0, len(texts), chunk):
        p = passages(texts[at : at + chunk])
        where = np.minimum(np.searchsorted(known, p.word), max(0, n - 1))
        is_name = known[where] == p.word if n else np.zeros(len(p.word), bool)
        named = np.zeros(p.n, bool)
        named[p.word_of[is_name]] = True
        take = named[p.word_of]
        twin, twin_of = _featured(np.where(is_name, to[where], p.word)[take] if n else p.word[take], p.word_of[take])
        parts.append([p.feature.astype(np.int32), (p.passage + before).astype(np.int32), (p.text + at).astype(np.int32), _content(p), twin.astype(np.int32), (twin_of + before).astype(np.int32)])
        before += p.n
    return Examples(*(np.concatenate(x) for x in zip(*parts)))


#: The most that a score from other labels counts for or against a label (log odds).
CAUTION = 4.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(texts: list[str], yes: np.ndarray, votes: np.ndarray, terms: list[str], identities: tuple[str, ...] = IDENTITIES, folds: int = 4, **settings) -> np.ndarray:
    """Weights of ``fit`` from texts that ``yes`` of ``votes`` reviewers call abusive.

    Reviewers err: how often is estimated from texts with several reviewers (with ten agreeing pairs added,
    so that it is defined for any number), and a text counts by how far its label is more likely right than
    wrong, given its votes and the score by weights fitted to the other folds' labels, which counts for at
    most ``CAUTION``. A label that both contradict counts for nothing. The same rule holds for any number of
    labels; without any, the listed ``terms`` alone decide, as they are where the weights start from.
    """
    differ, pairs = float((yes * (votes - yes)).sum()), float((votes * (votes - 1) / 2).sum())
    rate = min((differ + 1) / (pairs + 10), 0.45)
    error = (1 - (1 - 2 * rate) ** 0.5) / 2
    odds = (2 * yes - votes) * np.log((1 - error) / error)
    bad = odds > 0
    prior = np.zeros((1 << BITS) + 1)
    prior[-1] = -3.0
    for term in terms:
        p = passages([term])
        prior[p.feature[len(p.word) :] if len(p.word) > 1 else p.feature] = 4.0 / max(1, len(p.word) - 1)
    given = examples(texts, [*identities, *(n for n in group_names(texts) if n not in identities)])
    weight, checked = np.tanh(np.abs(odds) / 2), np.zeros(len(texts))
    fold = np.zeros(len(texts), int)
    for kind in (bad, ~bad):
        fold[kind] = np.arange(kind.sum()) % folds
    for k in range(folds):
        w = fit(given, bad, np.where(fold == k, 0.0, weight), prior, **settings)
        worst = np.full(len(texts), w[-1])
        np.maximum.at(worst, given.text, _sums(given.feature, given.passage, given.n, w) + w[-1])
        checked[fold == k] = worst[fold == k]
    side = np.where(bad, 1, -1)
    right = _sigmoid(side * (odds + np.clip(checked, -CAUTION, CAUTION)))
    return fit(given, bad, np.maximum(0.0, 2 * right - 1), prior, **settings)


def fit(
    given: Examples, bad: np.ndarray, weight: np.ndarray, prior: np.ndarray, rounds: int = 3, steps: int = 40, ridge: float = 0.02, pairing: float = 1.0,
) -> np.ndarray:
    """Weights of a logistic classifier of passages (the last is the constant), each text counting by ``weight``.

    A text is as bad as its worst passage: in each round the positive examples are the worst passages of
    bad texts by the weights so far (at first: by how much rarer their words are in the other texts), the
    negative ones all distinct passages of the others, with their weight. The weights are drawn towards
    ``prior``. Counterfactual regularisation: every passage that names a group is paired with its twin that
    names another group or a neutral word, and the square of the difference of the two scores, times
    ``pairing``, is added to the loss, so that the name itself carries no blame.

    After the first round, negative passages with a score below -7 wait. They come back for good where the
    weights move towards them, and rounds go on until none that waits has a score above -5, so that each
    passage left out would have added less than 0.7 % of its weight to any gradient.
    """
    text, n = given.text, given.n
    in_bad, in_used = bad[text], weight[text] > 0
    # by how much weight of texts of either kind hold each feature
    of = given.held & 0xFFFFFFFF
    n_bad, n_good = (np.bincount(given.held >> 32, weight[of] * (bad[of] == k), 1 << BITS) for k in (True, False))
    # log odds in units of their error, so that a word of one text alone counts less than one of several
    odds = np.log((n_bad + 0.5) / ((weight * bad).sum() + 1)) - np.log((n_good + 0.5) / ((weight * ~bad).sum() + 1))
    odds /= np.sqrt(1 / (n_bad + 0.5) + 1 / (n_good + 0.5))
    weights = prior.copy()
    weights[:-1] += np.where(n_bad > 0, odds, 0).clip(0, 4)
    score = _sums(given.feature, given.passage, n, weights) / np.sqrt(np.bincount(given.passage, minlength=n) + 4)

    good = np.flatnonzero(in_used & ~in_bad)
    _, first, which = np.unique(given.content[good], return_index=True, return_inverse=True)
    distinct, times = good[first], np.bincount(which, weight[text[good]], len(first))
    pairs = np.unique(given.twin_of)
    pairs = pairs[in_used[pairs]]
    pairs = pairs[np.unique(given.content[pairs], return_index=True)[1]]
    (pr, pf), (qr, qf) = _rows(given.feature, given.passage, n, pairs), _rows(given.twin, given.twin_of, n, pairs)

    candidates = np.flatnonzero(in_used & in_bad)
    near, round_ = np.ones(len(distinct), bool), 0
    while round_ < rounds or (score[distinct[~near]] > -5).any():
        order = candidates[np.lexsort((score[candidates], text[candidates]))]
        worst = order[np.r_[text[order][1:] != text[order][:-1], True]] if len(order) else order
        if round_:
            near = score[distinct] > -7 if round_ == 1 else near | (score[distinct] > -7)
        others, number = distinct[near], np.r_[weight[text[worst]], times[near]]
        target = np.r_[np.ones(len(worst)), np.zeros(len(others))]
        (row, col), (more, more_col) = _rows(given.feature, given.passage, n, worst), _rows(given.feature, given.passage, n, others)
        row, col = np.r_[row, more + len(worst)], np.r_[col, more_col]
        features = np.unique(np.concatenate([col, pf, qf]))
        to = np.zeros(1 << BITS, np.int32)
        to[features] = np.arange(len(features))
        col, own, other = to[col], to[pf], to[qf]
        start = np.r_[prior[features], prior[-1]]
        w = start.copy() if round_ == 0 else np.r_[weights[features], weights[-1]]
        moment, square = np.zeros(len(w)), np.zeros(len(w))
        for t in range(1, steps + 1):
            z = np.bincount(row, w[col], len(target)) + w[-1]
            error = number * (_sigmoid(z) - target)
            grad = ridge * (w - start)
            grad[:-1] += np.bincount(col, error[row], len(features))
            grad[-1] += error.sum()
            if len(pairs):
                gap = np.bincount(pr, w[own], len(pairs)) - np.bincount(qr, w[other], len(pairs))
                grad[:-1] += 2 * pairing * (np.bincount(own, gap[pr], len(features)) - np.bincount(other, gap[qr], len(features)))
            moment = 0.9 * moment + 0.1 * grad
            square = 0.99 * square + 0.01 * grad**2
            w -= 0.15 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
        weights = prior.copy()
        weights[features], weights[-1] = w[:-1], w[-1]
        score = _sums(given.feature, given.passage, n, weights) + weights[-1]
        round_ += 1
    return weights


def labelled(
    texts: DataFrame, labels: DataFrame, key: str, text: str, label: str, reviewer: str, most_bad: int = 1500, most_good: int = 4000, most_bytes: int = 32 << 20,
    scratch: Scratch | None = None,
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A bounded sample of labelled texts, in the order of their keys, with how many reviewers call each abusive and how many there are.

    At most ``most_bad`` texts that most of their reviewers call abusive and ``most_good`` others, picked by a hash
    of the key, are fetched, and of these the first by that hash, up to ``most_bytes`` of text in all, are
    used. A reviewer's repeated rows count once (the greatest label); null labels and null texts don't count.
    """
    scratch = scratch or Scratch(texts.sparkSession)
    one = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("key"), reviewer).agg(F.max(label).alias("vote"))
    known = one.groupBy("key").agg(F.sum((F.col("vote") > 0).cast("int")).alias("yes"), F.count(F.lit(1)).alias("votes"))
    order = F.xxhash64("key"), F.col("key")
    is_bad = F.col("yes") * 2 > F.col("votes")
    picked = known.filter(is_bad).orderBy(*order).limit(most_bad).unionAll(known.filter(~is_bad).orderBy(*order).limit(most_good))
    # at most most_bad + most_good keys; texts are read once, for these only
    found = scratch.keep(texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key"))
    # at most as many rows as are picked
    total = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = found.select("key", total.alias("total")).filter(F.col("total") <= most_bytes).select("key")
    rows = found.join(F.broadcast(within), "key").collect()
    scratch.close()
    rows.sort(key=lambda r: r["key"])
    return [r["text"] for r in rows], np.array([r["yes"] for r in rows], float), np.array([r["votes"] for r in rows], float)


def scored(texts: DataFrame, key: str, text: str, weights: np.ndarray, out: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``score`` of every row: that of the worst passage of the whole text; 0 for null and empty texts."""
    sent = texts.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 4 MB whatever the data

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            found, run, size = [], [], 0
            for value in [*values, None]:
                run.append(value or "")
                size += len(run[-1])
                if size > 1 << 20:
                    found.append(text_scores(run, sent.value))
                    run, size = [], 0
            if run:
                found.append(text_scores(run, sent.value))
            numbers = np.concatenate(found)[: len(values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(numbers)], names=[key, *keep, out])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return texts.select(key, text, *keep).mapInArrow(score, f"{kinds}, `{out}` double")
