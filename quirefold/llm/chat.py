"""Chat formatting: a compiler from a small sandboxed template language to Python closures.

A template is parsed into a syntax tree, constants are folded, and the tree becomes closures that
yield pieces of output, so a conversation of any length is rendered as a stream. The language:

    {{ expression }}        outputs; {% for x in list %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}; {% set name = e %}
    {% generation %} ... {% endgeneration %}   marks output under the loss mask

Expressions: strings, whole numbers, true, false, none, names, a.b, a['b'], + == != and or not,
parentheses, and the filters ``|escape``, ``|trim``, ``|upper``. Sandbox: only keys of dicts can be
read; nothing is called but the filters; no attribute of any Python object is reachable.

``|escape`` writes each backslash, ``<``, ``#`` and colon as a backslash and a letter (CODES), so no
text can hold a control string of the turn format; reading a turn back undoes it.

Edge cases: null role or text is empty; turns are ordered by turn, role, text (nulls first), so ties
and repeated rows have an order; a null conv_id is a conversation; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% for m in messages %}<turn>### {{ m.role|escape }}:\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}</turn>\n{% endfor %}"
)
OPEN, CLOSE = "<turn>### ", "</turn>\n"
#: What the characters of control strings are written as inside roles and texts.
CODES = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c"}
PLAIN = {v: k for k, v in CODES.items()}
FILTERS: dict[str, Callable[[str], str]] = {
    "escape": lambda s: re.sub(r"[\\<#:]", lambda m: CODES[m[0]], s),
    "trim": str.strip,
    "upper": str.upper,
}
TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+.\[\]()|=]))""")
ESCAPES = {"n": "\n", "t": "\t"}
#: A piece of output and whether it is under the loss mask.
Piece = tuple[str, bool]


def unescape(s: str) -> str:
    return re.sub(r"\\[\\lhc]", lambda m: PLAIN[m[0]], s)


class TemplateError(ValueError):
    """The template isn't in the language."""


class Parser:
    """Recursive descent over the tokens of one tag; trees are tuples (kind, parts ...)."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, object]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"bad expression at {text[at:]!r}")
            at = m.end()
            string, number, name, mark = m.groups()
            if string is not None:
                body = re.sub(r"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), string[1:-1], flags=re.S)
                self.tokens.append(("const", body))
            elif number is not None:
                self.tokens.append(("const", int(number)))
            else:
                self.tokens.append(("name", name) if name else ("mark", mark))
        self.at = 0

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: object = None) -> object:
        found = self.peek()
        if kind and found[0] != kind or value is not None and found[1] != value:
            raise TemplateError(f"expected {value or kind}, found {found[1]!r}")
        self.at += 1
        return found[1]

    def accept(self, value: str) -> bool:
        if self.peek() in (("mark", value), ("name", value)):
            self.at += 1
            return True
        return False

    def done(self, tree: tuple) -> tuple:
        self.take("end")
        return tree

    def either(self) -> tuple:
        left = self.both()
        while self.accept("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.accept("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.accept("not") else self.compared()

    def compared(self) -> tuple:
        left = self.added()
        for mark in ("==", "!="):
            if self.accept(mark):
                return (mark, left, self.added())
        return left

    def added(self) -> tuple:
        left = self.filtered()
        while self.accept("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.atom()
        while True:
            if self.accept("."):
                left = ("key", left, ("const", self.take("name")))
            elif self.accept("["):
                left = ("key", left, self.either())
                self.take("mark", "]")
            elif self.accept("|"):
                name = self.take("name")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                left = ("filter", name, left)
            else:
                return left

    def atom(self) -> tuple:
        if self.accept("("):
            inner = self.either()
            self.take("mark", ")")
            return inner
        kind, value = self.peek()
        if kind not in ("const", "name"):
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        words = {"true": True, "false": False, "none": None}
        return ("const", words[value]) if kind == "name" and value in words else (kind, value)


def parse(template: str) -> list[tuple]:
    """The template's tree: a list of statements."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    tags = [p for p in parts if p]
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(tags):
            tag = tags[at]
            at += 1
            if tag.startswith("{{"):
                p = Parser(tag[2:-2])
                out.append(("out", p.done(p.either())))
            elif not tag.startswith("{%"):
                out.append(("out", ("const", tag)))
            else:
                body = tag[2:-2].strip()
                word = body.split(None, 1)[0] if body else ""
                if word in ends:
                    return out, body
                out.append(statement(word, Parser(body[len(word) :])))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return out, ""

    def statement(word: str, p: Parser) -> tuple:
        if word == "for":
            name = p.take("name")
            p.take("name", "in")
            over = p.done(p.either())
            return ("for", name, over, block(("endfor",))[0])
        if word == "if":
            test, cases = p.done(p.either()), []
            while True:
                body, end = block(("elif", "else", "endif"))
                cases.append((test, body))
                if end.startswith("elif"):
                    q = Parser(end[4:])
                    test = q.done(q.either())
                elif end == "else":
                    test = ("const", True)
                else:
                    return ("if", cases)
        if word == "set":
            name = p.take("name")
            p.take("mark", "=")
            return ("set", name, p.done(p.either()))
        if word == "generation":
            return ("generation", block(("endgeneration",))[0])
        raise TemplateError(f"unknown tag {word}")

    return block(())[0]


def text_of(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def plus(a: object, b: object) -> object:
    return a + b if isinstance(a, int) and isinstance(b, int) else text_of(a) + text_of(b)


def fold(tree):
    """The tree with all constant subexpressions computed, joined and pruned."""
    if isinstance(tree, list):
        out: list[tuple] = []
        for node in map(fold, tree):
            if node[0] == "out" and node[1] == ("const", ""):
                continue
            if node[0] == "if" and node[1] and node[1][0][0] == ("const", True):
                out += node[1][0][1]
            elif node[0] == "out" and node[1][0] == "const" and out and out[-1][0] == "out" and out[-1][1][0] == "const":
                out[-1] = ("out", ("const", text_of(out[-1][1][1]) + text_of(node[1][1])))
            elif node != ("if", []):
                out.append(node)
        return out
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "if":
        cases = [(fold(t), fold(b)) for t, b in tree[1]]
        cases = [(t, b) for t, b in cases if t[0] != "const" or t[1]]
        sure = next((i for i, (t, _) in enumerate(cases) if t[0] == "const"), len(cases))
        return ("if", [(("const", True), b) if t[0] == "const" else (t, b) for t, b in cases[: sure + 1]])
    if kind == "for":
        return ("for", tree[1], fold(tree[2]), fold(tree[3]))
    if kind == "generation":
        return ("generation", fold(tree[1]))
    folded = (kind, *[fold(x) if isinstance(x, tuple) else x for x in tree[1:]])
    if kind not in ("set", "out") and all(not isinstance(x, tuple) or x[0] == "const" for x in folded[1:]):
        return ("const", expression(folded)({}))
    return folded


def expression(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda env: value
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "filter":
        f, inner = FILTERS[tree[1]], expression(tree[2])
        return lambda env: f(text_of(inner(env)))
    if kind == "not":
        inner = expression(tree[1])
        return lambda env: not inner(env)
    a, b = expression(tree[1]), expression(tree[2])
    if kind == "key":

        def key(env: dict) -> object:
            owner = a(env)
            return owner.get(b(env)) if isinstance(owner, dict) else None

        return key
    return {
        "or": lambda env: a(env) or b(env),
        "and": lambda env: a(env) and b(env),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "+": lambda env: plus(a(env), b(env)),
    }[kind]


def closure(tree: list[tuple], mask: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """A function that yields the pieces of a list of statements."""
    steps = [one(node, mask) for node in tree]

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def one(node: tuple, mask: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "out":
        value = expression(node[1])
        return lambda env: iter(((text_of(value(env)), mask),))
    if kind == "generation":
        return closure(node[1], True)
    if kind == "set":
        name, value = node[1], expression(node[2])

        def assign(env: dict) -> Iterator[Piece]:
            env[name] = value(env)
            return iter(())

        return assign
    if kind == "if":
        cases = [(expression(t), closure(b, mask)) for t, b in node[1]]

        def choose(env: dict) -> Iterator[Piece]:
            for test, body in cases:
                if test(env):
                    yield from body(env)
                    return

        return choose
    name, over, body = node[1], expression(node[2]), closure(node[3], mask)

    def loop(env: dict) -> Iterator[Piece]:
        items = over(env)
        if items is None or isinstance(items, (str, int, dict)):
            return
        for item in items:
            yield from body({**env, name: item})

    return loop


def compiled(template: str) -> Callable[[dict], Iterator[Piece]]:
    return closure(fold(parse(template)))


def rendered(template: str, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The whole output and the code point spans under the loss mask."""
    out, spans, at = [], [], 0
    for text, mask in compiled(template)({"messages": messages}):
        if mask and text:
            spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


class Reader:
    """Reads turns back from TEMPLATE's output as it arrives, and digests them."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss, self.buffer = hashlib.sha256(), hashlib.sha256(), []

    def feed(self, text: str, mask: bool) -> None:
        self.formatted_chars += len(text)
        if mask:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.buffer.append(text)
        if CLOSE in text:
            self.turn("".join(self.buffer))
            self.buffer = []

    def turn(self, raw: str) -> None:
        """All turns that end in ``raw``: an unescaped CLOSE can't be inside a role or text."""
        for part in raw.split(CLOSE)[:-1]:
            _, begins, turn = part.partition(OPEN)  # text before a turn isn't part of it
            if not begins:
                raise ValueError(f"no turn begins in {part[:40]!r}")
            role, _, text = turn.partition(":\n")
            role, text = unescape(role), unescape(text)
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())


OUT = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def mentions(tree: object, name: str) -> int:
    """How often a syntax tree names a variable."""
    if tree == ("name", name):
        return 1
    return sum(mentions(x, name) for x in tree) if isinstance(tree, (list, tuple)) else 0


def streams(template: str) -> bool:
    """Whether a template goes through the messages once, in a loop of its own: they may stream then."""
    tree = fold(parse(template))
    loops = sum(node[0] == "for" and node[2] == ("name", "messages") for node in tree)
    return loops == 1 and mentions(tree, "messages") == 1


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: digests of its turns and loss texts, read back from the output.

    Rows are dealt by conversation and sorted in each part. A conversation is rendered as one list of
    messages. A template that goes through them once gets them as its rows stream by, so their number
    isn't bounded by memory; for others the list is held. ``template`` must keep TEMPLATE's turn
    format, which the reader checks; other text around turns isn't read. Rows without a conv_id are
    one conversation; an empty table gives no rows.
    """
    once = streams(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows = compiled(template), []
        names = [c.split()[0] for c in OUT.split(", ")]

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        told = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True))
        for conv, group in groupby(told, key=lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in group)
            reader = Reader()
            for piece, mask in render({"messages": messages if once else list(messages)}):
                reader.feed(piece, mask)
            rows.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted_chars))
            if len(rows) >= 1000:
                yield flush()
        if rows:
            yield flush()

    by = ["conv_id", "turn", "role", "text"]
    dealt = conversations.select(*by).repartition("conv_id").sortWithinPartitions(*by)
    return dealt.select("conv_id", "role", "text").mapInArrow(run, OUT)


#: A conversation that says the control strings themselves (fixed by the query's contract).
PROBE = r"\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    rows = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    extra = conversations.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
