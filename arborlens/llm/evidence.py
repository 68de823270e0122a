"""Evidence of a file's content and name for its label, with weights learned from own fixtures.

A file is measured by numbers that hold for any code: line lengths, white space,
entropy, lengths and repetition of identifiers, shares of comments, data and
code words. Remarks in comments count as weak marks, each beside its product
with the house's own notice, so that the fit can weigh one against the other. A
softmax regression on a bounded number of fixtures turns the numbers into
log-likelihood ratios.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .fixtures import OWNER, make_files

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GENERATED, MINIFIED, VENDORED, BLOB = range(5)


@dataclass(frozen=True)
class HouseStyle:
    """Names by which notices show a file to be the house's own; without names no notice does."""

    owners: tuple[str, ...] = ()


_COMMENT = re.compile(r"^\s*(?://+[!/]?|#+!?(?!line\b)|/\*+!?|\*+/?(?=\s|$)|--+(?=\s|$)|;+(?=\s)|<!--|%+(?=\s)|\"\"\"|''')\s?(.*)$")
_CLOSING = re.compile(r"\s*(?:\*/|-->|\"\"\"|''')(.*)$")
_BLOCKS = ("/*", "<!", '""', "''")
# How tools and owners announce themselves, in the languages that notices are commonly written in.
_MADE = (
    r"(?:auto[- ]?)?generated|auto[- ]?generated|machine[- ](?:generated|made|written)|(?:produced|created|written|made|emitted|wrote)"
    r"|automatisch (?:erzeugt|erstellt|generiert)|généré|produit|generado|generato|gegenereerd|自動生成|自动生成|создан автоматически|автоматически создан"
)
_TOOL_NOTICE = re.compile(
    rf"^(?:@generated\b|<?auto-?generated\b|(?:(?:this|the) )?(?:(?:file|code|source|module|fichier|archivo|código|datei) )?(?:(?:is|was|has been) )?(?:automatically )?(?:{_MADE})(?: automatically| automatiquement| automáticamente)?"
    r"(?:\s+(?:by|from|with|using|out of|von|par|por|da|door)\b|[.,;!>]|$)|\S+ (?:v?[\d.]+ )?(?:emitted|wrote|produced|generated) \d+\b)",
    re.IGNORECASE,
)
_HANDS_OFF = re.compile(
    r"\bdo not (?:edit|modify)\b(?! while| it there)|\b(?:edits|changes) (?:are|will be) (?:lost|overwritten)\b|\bnicht von hand\b|\bne pas (?:modifier|éditer)\b"
    r"|\bno (?:editar|modificar)\b|\bnon modificare\b|編集しない|请勿(?:修改|编辑)|не редактировать",
    re.IGNORECASE,
)
_TERMS = re.compile(r"copyright|\(c\)|©|all rights reserved|\blicen[cs]ed? under\b|@license|SPDX-License-Identifier", re.IGNORECASE)
_GRANT = re.compile(r"SPDX-License-Identifier|@license|\blicen[cs]e\b|\bredistribution\b|\bpermission is (?:hereby )?granted\b|@v?\d+\.\d+[\w.]* by\b|\bits own terms\b", re.IGNORECASE)
_ORIGIN = re.compile(r"^(?:(?:copied|taken(?: over)?|borrowed|imported|vendored|forked|mirror(?:ed)?|local copy)\b.*?\d+\.\d+|.*?\d+\.\d+.*\b(?:upstream|imported)\b)", re.IGNORECASE)
_LOCATED = re.compile(r"^\s*(?://|#) ?line\s+(?:\S+:\d+|\d+ \")", re.MULTILINE)
_STATE = re.compile(r"^\s*(?://|#|/\*|\*|--)\s*(?:state|rule|prod|production|item|action|goto|symbol|token)s?\s+\d+\s*:", re.MULTILINE | re.IGNORECASE)
_INPUT = re.compile(r"^(?:source|tables? of|derived from|compiled from|input)\b:?\s+\S+\.\w+$", re.IGNORECASE)
_DIGEST = re.compile(r"\b[0-9a-f]{16,}\b")
_COMMAND = re.compile(r"^\$? ?[\w./-]+(?: v?[\d.]+)? (?:.* )?--?[a-z][\w=-]*(?: |$)")
_OUTPUT_OF = re.compile(r"\b\w+\.[a-z]\w*\b.*\b(?:v?\d+\.\d+|\d+ \w+)|\b(?:v?\d+\.\d+|\d+ \w+)\b.*\b\w+\.[a-z]\w*\b", re.IGNORECASE)
_MAP = re.compile(r"^\s*(?://|/\*)[#@] ?sourceMappingURL=", re.MULTILINE)
_TOOL_NAME = re.compile(r"(?:[._-](?:g|gen|generated|autogen|pb|pb2|pb2_grpc|pbgo|designer)(?:\.[a-z]+)*|_pb2?|_pb2_grpc|\.pb\.\w+)$", re.IGNORECASE)
_MIN_NAME = re.compile(r"(?:[.-]min|[.-]prod|[.-]bundle|[.-]packed|\.[0-9a-f]{8,})$", re.IGNORECASE)
_DATA = re.compile(r"^[\s\[\](){},;+\\|:=]*(?:(?:0x[0-9a-f]+|-?\d[\d._]*(?:e-?\d+)?|\"[^\"]*\"|'[^']*'|`[^`]*`|true|false|null|none|nil)[\s\[\](){},;+\\|:=]*)+$", re.IGNORECASE)
_SEPARATED = re.compile(r"^[^\s(){}=]*[;,|\t][^(){}=]*[;,|\t][^(){}=]*$|^insert into\b", re.IGNORECASE)
_WORDS = re.compile(r"[^\W\d]\w*")
# Words that open declarations and statements, common to most languages and by language.
_CODE_WORDS = frozenset(
    "function class def fn func return if elif else for while loop match switch case impl pub import use package struct interface type enum trait async await with raise throw defer yield try except catch let const var from export"
    .split()
)
_BY_LANGUAGE = {"sql": frozenset("select from where join create view table group order update delete".split()), "shell": frozenset("then fi do done echo esac function export local".split())}
_OF_EXTENSION = {"sql": "sql", "sh": "shell", "bash": "shell"}
_SAMPLE_SEED = 0


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def comments_of(lines: list[str]) -> list[tuple[int, str]]:
    """(line, text) of comments; of a block only its own part of a line counts, as code may follow."""
    found, inside = [], False
    for i, line in enumerate(lines):
        m = _COMMENT.match(line)
        if not m and not inside:
            continue
        text = m[1] if m else line
        opens = m is not None and line.lstrip()[:2] in _BLOCKS
        end = _CLOSING.search(text) if opens or inside or text.rstrip().endswith(("*/", "-->")) else None
        if end and not end[1].strip():
            text, inside = text[: end.start()], False
        elif end:
            text, inside = text[: end.start()], False
        elif opens and line.lstrip()[:2] in ("/*", "<!"):
            inside = True
        found.append((i, text.strip()))
    return found


#: Numbers of style tell code, packed code and data apart, not whose code it is: their weights are the same for the labels of readable code.
STYLE = 17
FEATURES = [
    "line_length", "wide_length", "blank", "indented", "comments", "code_words", "data_lines", "entropy", "digits", "signs",
    "word_length", "short_words", "new_words", "new_lines", "few_lines", "wide_words", "data_words", "notice", "hands_off", "located", "states", "input", "digest", "command", "footer",
    "tool_name", "min_name", "map", "terms", "grant", "origin", "house", "house_notice", "house_hands_off", "house_terms", "constant",
]


def features(name: str, content: bytes | None, style: HouseStyle, language: str | None = None) -> list[float] | None:
    """The numbers named in ``FEATURES`` for a whole content; None for a blank one."""
    text = (content or b"").decode("utf-8", "replace")
    lines = [line for line in text.splitlines() if line.strip()]
    if not lines:
        return None
    stem, dot, extension = name.rpartition(".") if "." in name.lstrip(".") else (name, "", "")
    size = sum(map(len, lines))
    comments = comments_of(lines)
    marked = {i for i, _ in comments}
    header, last = [], -1
    for i, comment in comments:
        if i > last + 1:
            break
        header.append(comment)
        last = i
    ends = [c for i, c in comments if i == len(lines) - 1]
    body = [line for i, line in enumerate(lines) if i not in marked] or lines
    words = _WORDS.findall("\n".join(body))
    own = _CODE_WORDS | _BY_LANGUAGE.get(language.lower() if language else _OF_EXTENSION.get(extension.lower(), ""), frozenset())
    opening = sum(1 for line in body if (w := _WORDS.findall(line)) and any(x.lower() in own for x in w[:3]))
    data = sum(len(line) for line in body if _DATA.match(line) or _SEPARATED.match(line.strip()))
    body_size = sum(map(len, body))
    shapes = len({re.sub(r"\w+", "w", line) for line in body})
    house = any(o.lower() in c.lower() for o in style.owners for c in header)
    notice = any(_TOOL_NOTICE.match(c) for c in (*header, *ends))
    hands_off = any(_HANDS_OFF.search(c) for c in (*header, *ends))
    terms = not house and any(_TERMS.search(c) for c in header)
    grant = not house and any(_GRANT.search(c) for c in header)
    n = len(body)
    wide = math.log(sum(len(line) ** 2 for line in body) / body_size)
    code, by_data = opening / n, data / body_size
    short = sum(1 for w in words if len(w) <= 2) / max(1, len(words))
    return [
        math.log(size / len(lines)) - 3.5,
        wide - 4.0,
        sum(line.count(" ") + line.count("\t") for line in body) / body_size * 4,
        sum(line[0] in " \t" for line in body) / n,
        len(comments) / len(lines),
        code * 2,
        by_data * 2,
        _entropy("".join(body)) - 4.5,
        sum(c.isdigit() for line in body for c in line) / body_size * 4,
        sum(line.count(c) for line in body for c in ";,(){}[]") / body_size * 4,
        sum(map(len, words)) / max(1, len(words)) / 4,
        short * 2,
        -1.0 / (1.0 + 5 * len(set(words)) / max(1, len(words))),
        -1.0 / (1.0 + 5 * shapes / n),
        float(n <= 3),
        (wide - 4.0) * short * 2,
        by_data * (1 - code) * 4,
        float(notice),
        float(hands_off),
        min(1.0, 12 * len(_LOCATED.findall(text)) / len(lines)),
        min(1.0, 8 * len(_STATE.findall(text)) / len(lines)),
        float(any(_INPUT.match(c) for c in header)),
        float(any(_DIGEST.search(c) for c in (*header, *ends))),
        float(any(_COMMAND.search(c) for c in (*header, *ends))),
        float(any(_OUTPUT_OF.search(c) for c in ends)),
        float(bool(_TOOL_NAME.search(stem))),
        float(bool(_MIN_NAME.search(stem))),
        float(bool(_MAP.search(text))),
        float(terms),
        float(grant),
        float(not house and any(_ORIGIN.match(c) for c in header)),
        float(house),
        float(house and notice),
        float(house and hands_off),
        float(house and any(_GRANT.search(c) for c in header)),
        1.0,
    ]


@lru_cache(maxsize=2)
def fitted(per_generator: int = 60, rounds: int = 400, decay: float = 1e-4) -> np.ndarray:
    """Weights (features by labels) of a softmax regression on the fitted generators: at most ``per_generator`` files of each.

    Labels weigh equally. Steps follow Adam; the fit is the same each time.
    """
    files = make_files(per_generator, held_out=False, seed=_SAMPLE_SEED)
    rows = [(LABELS.index(label), features(name, content, HouseStyle((OWNER,)))) for label, name, content in files]
    x = np.array([f for _, f in rows if f is not None])
    y = np.array([label for label, f in rows if f is not None])
    weight = (1.0 / np.bincount(y, minlength=5))[y] / 5
    w = np.zeros((x.shape[1], 5))
    mean, square, readable = np.zeros_like(w), np.zeros_like(w), [HAND, GENERATED, VENDORED]
    for step in range(1, rounds + 1):
        score = x @ w
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1.0
        gradient = x.T @ (p * weight[:, None]) + decay * w / len(FEATURES)
        gradient[:STYLE, readable] = gradient[:STYLE, readable].mean(axis=1, keepdims=True)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return w


#: Blank files are hand work; no evidence counts for more than this.
MOST = 14.0


def file_evidence(name: str, content: bytes | None, style: HouseStyle = HouseStyle(), language: str | None = None, weights: np.ndarray | None = None) -> list[float]:
    """Log-likelihood of a file's content and name under each label, up to a constant.

    The whole content counts; bytes that are no UTF-8 are replaced. Null and
    blank content speaks for nothing but hand work.
    """
    found = features(name, content, style, language)
    if found is None:
        return [MOST, 0.0, 0.0, 0.0, 0.0]
    score = np.array(found) @ (fitted() if weights is None else weights)
    return np.clip(score - score.max(), -MOST, 0.0).tolist()
