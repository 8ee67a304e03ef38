"""A linear-chain conditional random field over word shapes.

A token's score for each label is a sum over its own features and those of the tokens before and after it; labels of
neighbours interact through one table. Training climbs the conditional log-likelihood by forward-backward; decoding is
Viterbi over many sequences at once, padded to a common length.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np

PLACES = 2048
#: Tokens whose scores a decoder keeps, and padded cells it decodes at once.
CACHED_TOKENS, CELLS = 300_000, 200_000
RUNS = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "9")]
CORE = re.compile(r"[A-Za-z0-9+/_=\-]+")


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits as A, a and 9; other characters as they are. At most 12 characters."""
    for pattern, letter in RUNS:
        token = pattern.sub(letter, token)
    return token[:12]


def case_changes(core: str) -> int:
    """How often a capital follows a small letter, at most 2: words that are run together have it, prose has not."""
    return min(2, sum(a.islower() and b.isupper() for a, b in zip(core[:64], core[1:64], strict=False)))


def token_features(token: str) -> list[str]:
    """Of the token itself; the names don't say where it stands."""
    core = max(CORE.findall(token) or [""], key=len)
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    mixed = "mixed" if digits > 1 and letters > 1 else "digits" if digits and not letters else "letters" if letters else "none"
    found = [
        "bias",
        f"core {mixed} {min(len(core) // 8, 4)}",
        f"hex {bool(re.fullmatch('[0-9a-fA-F]{16,}', core))} {mixed}",
        f"at {'@' in token}",
        f"quoted {token[0] in chr(34) + chr(39)}",
        f"assign {token.rstrip('!#$%&*') in ('=', ':', ':=', '=>')}",
        f"cases {case_changes(core)}",
    ]
    plain = token.lower().strip("\"':;,.!?#$%&*=()[]{}")
    if len(token) <= 24:
        found.append(f"shape {shape(token)}")
    if plain in KEY_WORDS:
        found.append("key word")
        found.append(f"ends {token.rstrip('!#$%&*')[-1:] in ('=', ':')}")
    return found


#: Words that announce a credential.
KEY_WORDS = frozenset(["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "access_key", "secret_key", "auth", "bearer", "credential", "key", "passwort", "contraseña", "motdepasse"])


PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-Þß-öø-ÿ][a-zß-öø-ÿ]{0,14}")
CAPITALS, DIGITS = re.compile(r"[A-Z]{2,15}"), re.compile(r"[0-9]{1,24}")


def form(token: str) -> str:
    """A token with the same features. Plain words of a length differ in their letters only, and so do numbers."""
    if token[-1:] in (".", ",") and PLAIN.fullmatch(token[:-1]) and token.isascii():
        alike = form(token[:-1])
        return token if alike == token[:-1] and alike.lower() in KEY_WORDS else alike + token[-1]
    if PLAIN.fullmatch(token):
        if token.lower() in KEY_WORDS:
            return token
        first, n = "X" if token[0].isupper() else "x", len(token)
        if token.isascii():
            return first + "x" * (n - 1)
        core = max(map(len, CORE.findall(token)), default=0)  # other letters interrupt it
        return plain_form(first == "X", n, min(core // 8 + 1, 2) if core else 0)
    if CAPITALS.fullmatch(token) and token.lower() not in KEY_WORDS:
        return "X" * len(token)
    return "9" * len(token) if DIGITS.fullmatch(token) else token


def plain_form(capital: bool, n: int, core: int) -> str:
    """The form of words of n letters, some of them not ASCII: without a core, with a short one, or with one of 8 letters or more."""
    if not core:
        return ("É" if capital else "é") + "é" * (n - 1)
    kept = 1 if core == 1 else 8
    return ("X" if capital else "x") + "x" * (kept - 1) + "é" * (n - kept)


def places(token: str, side: str, features: list[str] | None = None) -> list[int]:
    return [zlib.crc32(f"{side} {name}".encode()) % PLACES for name in (token_features(token) if features is None else features)]


@dataclass
class Crf:
    """Labels, and the weights of features and of neighbouring labels."""

    labels: list[str]
    emission: np.ndarray
    transition: np.ndarray

    def decoder(self) -> Decoder:
        return Decoder(self)


def sentence_places(tokens: list[str]) -> list[list[int]]:
    own = [places(t, "own") for t in tokens]
    for i in range(len(tokens)):
        if i:
            own[i] = own[i] + places(tokens[i - 1], "before")
        if i + 1 < len(tokens):
            own[i] = own[i] + places(tokens[i + 1], "after")
    return own


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(sentences: list[tuple[list[str], list[str]]], labels: list[str], rounds: int = 120, rate: float = 0.3, decay: float = 0.01) -> Crf:
    """Adagrad on the penalised conditional log-likelihood of labelled sentences."""
    number = {label: i for i, label in enumerate(labels)}
    emission, transition = np.zeros((PLACES, len(labels))), np.zeros((len(labels), len(labels)))
    squares = [np.full_like(emission, 1e-6), np.full_like(transition, 1e-6)]
    prepared = [(sentence_places(tokens), [number[x] for x in gold]) for tokens, gold in sentences if tokens]
    for _ in range(rounds):
        slope_e, slope_t = decay * emission, decay * transition
        for at, gold in prepared:
            score = np.stack([emission[p].sum(axis=0) for p in at])
            ahead, behind = score.copy(), np.zeros_like(score)
            for i in range(1, len(at)):
                ahead[i] += log_sum(ahead[i - 1][:, None] + transition, 0)
            for i in range(len(at) - 2, -1, -1):
                behind[i] = log_sum(transition + (score[i + 1] + behind[i + 1])[None, :], 1)
            total = log_sum(ahead[-1], 0)
            share = np.exp(ahead + behind - total)
            for i, p in enumerate(at):
                share[i, gold[i]] -= 1
                np.add.at(slope_e, p, share[i])
                if i:
                    slope_t += np.exp(ahead[i - 1][:, None] + transition + (score[i] + behind[i])[None, :] - total)
                    slope_t[gold[i - 1], gold[i]] -= 1
        for weight, slope, square in ((emission, slope_e, squares[0]), (transition, slope_t, squares[1])):
            square += slope**2
            weight -= rate * slope / np.sqrt(square)
    return Crf(labels, emission, transition)


class Decoder(dict):
    """Viterbi decoding. Maps a token to its row of scores: by itself, for the token after it, for the one before it.

    Row 0 stands for no token. Most words are plain and stand among plain ones; for those, `_calm` proves from the weights that
    in the best path they have the first label if no other word is within `reach`. Only the rest is decoded, with `reach` words
    on either side; the result is that of the whole sequence. Weights that prove nothing have everything decoded.
    """

    def __init__(self, model: Crf):
        super().__init__()
        self.model = model
        self.calm_forms: set[str] = set()
        self.reach = 1
        self._restart()
        self.calm_forms, self.reach = self._calm()
        self._restart()

    def _restart(self) -> None:
        self.clear()
        self.rows: list[np.ndarray] = [np.zeros((3, len(self.model.labels)))]
        self.calm: list[bool] = [True]

    def _calm(self) -> tuple[set[str], int]:
        """The forms of plain words, and how far from other words they surely have the first label; no forms if there is no proof.

        A run of other labels over plain words between two contexts is compared with the first label in their place. `enter`
        and `leave` have the contexts as rows and columns (the labels, then no word at all), `inner` is a step within a run;
        each holds the gain in score, with the least loss that any plain word among plain ones has by the label. If steps lose, longer runs
        lose more; runs between words of the first label, or ends of the sequence, must lose at any length, others from `reach` on.
        """
        words = [first + "x" * n for first in "Xx" for n in range(15)]
        words += [plain_form(capital, n, core) for capital in (False, True) for core in range(3) for n in range((0, 2, 9)[core] or 1, 16)]
        words = [word for word in dict.fromkeys(words) if form(word) == word]
        rows = np.stack([self.rows[self[word]] for word in words])
        ahead = (rows[:, :, :1] - rows[:, :, 1:]).min(axis=0)
        loss, change = ahead[0] + np.minimum(ahead[1:], 0).sum(axis=0), self.model.transition
        inner = change[1:, 1:] - change[0, 0] - loss
        enter = np.vstack([change[:, 1:] - change[:, :1] - loss, -loss])
        leave = np.hstack([change[1:] - change[:1], np.zeros((len(loss), 1))])
        calm_contexts = np.ix_([0, -1], [0, -1])
        reach = 0
        if len(loss) and inner.max() < -1e-6:
            for length in range(1, 50):
                gain = (enter[:, :, None] + leave[None]).max(axis=1)
                if gain[calm_contexts].max() > -1e-6:
                    return set(), 1
                if gain.max() < -1e-6:
                    reach = length
                    break
                enter = (enter[:, :, None] + inner[None]).max(axis=1)
        return (set(words), reach) if reach else (set(), 1)

    def __missing__(self, token: str) -> int:
        alike = form(token)
        if alike != token:
            self[token] = at = self[alike]
            return at
        self[token] = at = len(self.rows)
        features = token_features(token)
        self.rows.append(np.stack([self.model.emission[places(token, side, features)].sum(axis=0) for side in ("own", "before", "after")]))
        self.calm.append(token in self.calm_forms)
        return at

    def decode(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each sentence, as numbers."""
        ends = np.cumsum([len(s) + 1 for s in sentences], dtype=np.int64)
        flat = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)  # no token at the start and after each sentence
        for sentence, end in zip(sentences, ends, strict=True):
            if sentence:
                flat[end - len(sentence) : end] = list(map(self.__getitem__, sentence))
        calm = np.array(self.calm)[flat]
        near = ~calm
        for _ in range(1 + self.reach):  # a neighbour's features count too
            near[1:] |= near[:-1].copy()
            near[:-1] |= near[1:].copy()
        near &= flat > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).view(np.int8)))
        labels = np.zeros(len(flat), np.int64)
        parts = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        order = sorted(range(len(parts)), key=lambda i: parts[i][1] - parts[i][0])
        while order:
            batch = [order.pop()]
            longest = parts[batch[0]][1] - parts[batch[0]][0]
            while order and (len(batch) + 1) * longest <= CELLS:
                batch.append(order.pop())
            for i, found in zip(batch, self._viterbi([flat[slice(*parts[i])] for i in batch], longest), strict=True):
                labels[slice(*parts[i])] = found
        if len(self) > CACHED_TOKENS:
            self._restart()
        return [labels[end - len(s) : end] for s, end in zip(sentences, ends, strict=True)]

    def _viterbi(self, batch: list[np.ndarray], longest: int) -> list[np.ndarray]:
        size, n_labels = np.array([len(s) for s in batch]), len(self.model.labels)
        at = np.zeros((len(batch), longest), np.int64)
        for row, sentence in zip(at, batch, strict=True):
            row[: len(sentence)] = sentence
        known, at = np.unique(at, return_inverse=True)  # of all rows that are kept, a batch needs a few
        table, at = np.stack([self.rows[i] for i in known.tolist()]), at.reshape(len(batch), longest)
        score = table[at, 0]
        score[:, 1:] += table[at[:, :-1], 1]
        score[:, :-1] += table[at[:, 1:], 2]
        best, came = score[:, 0], np.zeros((len(batch), longest, n_labels), np.int8)
        for i in range(1, longest):
            through = best[:, :, None] + self.model.transition[None]
            came[:, i] = through.argmax(axis=1)
            step = through.max(axis=1) + score[:, i]
            best = np.where((i < size)[:, None], step, best)
        labels, rows = best.argmax(axis=1), np.arange(len(batch))
        path = np.zeros((len(batch), longest), np.int64)
        for i in range(longest - 1, -1, -1):
            path[:, i] = labels
            if i:
                labels = np.where(i < size, came[rows, i, labels], labels)
        return [p[:n] for p, n in zip(path, size, strict=True)]
