"""Chat formatting: a small sandboxed template language, compiled to Python closures.

The language has text, ``{{ expression }}``, ``{% for m in messages %}``, ``{% if %}/{% elif %}/{% else %}``,
and ``{% generation %}`` around what a model shall learn. Expressions know string and whole-number literals,
``m.role``, ``m.text``, ``loop.first``, ``loop.index``, ``+``, ``==``, ``!=``, ``and``, ``or``, ``not`` and the filters
``escape``, ``trim``, ``upper``, ``lower``. Nothing else exists: no attribute access, call or import can be written.

``escape`` puts a backslash before each ``\\``, ``<`` and ``[``, so that no text can hold a control string of the
template; ``unescape`` takes it back.

Rows: one per turn. Turns are ordered by ``turn`` (null first), then role, then text; null roles and texts are
empty; rows with a null conversation id form one conversation with a null id; repeated rows are turns of their own;
an empty table gives an empty result. A conversation streams through its task turn by turn, so one with very many
turns needs no more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each message alone between control strings; its role, then its text.
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {% elif m.role == 'assistant' %}<s>[ANSWER] {% else %}<s>[ROLE] {{ m.role | escape }}[TEXT] {% endif %}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{% if m.role == 'user' %} [/INST]{% endif %}</s>\n"
    "{% endfor %}"
)

# ---- syntax tree ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    value: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition or None, body)


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    """The template does not parse."""


_PART = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(==|!=|[+|()]))")
FILTERS: dict[str, Callable[[str], str]] = {}


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS |= {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class _Expression:
    """Recursive descent; gives nested tuples, operator first."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return next((x for x in self.tokens[self.at] if x is not None), "") if self.at < len(self.tokens) else ""

    def take(self, what: str) -> bool:
        if self.peek() == what:
            self.at += 1
            return True
        return False

    def whole(self) -> tuple:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        out = self.added()
        for op in ("==", "!="):
            if self.take(op):
                return (op, out, self.added())
        return out

    def added(self) -> tuple:
        out = self.filtered()
        while self.take("+"):
            out = ("+", out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            out = ("filter", name, out)
        return out

    def atom(self) -> tuple:
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("expected )")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        text, number, name, _ = self.tokens[self.at]
        self.at += 1
        if text is not None:
            return ("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if number is not None:
            return ("literal", int(number))
        if name in ("true", "false"):
            return ("literal", name == "true")
        if name is None or name.count(".") != 1 or name.split(".")[1] not in ("role", "text", "first", "index"):
            raise TemplateError(f"unknown name {name!r}")
        return ("name", *name.split("."))


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("tag", m[1]) if m[1] is not None else ("out", m[2]))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    place = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        out = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                out.append(Text(value))
            elif kind == "out":
                out.append(Output(_Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(out), value
                if word == "generation":
                    out.append(Generation(body("endgeneration")[0]))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*) in messages", rest)
                    if not m:
                        raise TemplateError(f"unknown loop {rest!r}")
                    out.append(For(m[1], body("endfor")[0]))
                elif word == "if":
                    branches, condition = [], _Expression(rest).whole()
                    while True:
                        inner, end = body("elif", "else", "endif")
                        branches.append((condition, inner))
                        if end == "endif":
                            break
                        condition = None if end == "else" else _Expression(end.partition(" ")[2]).whole()
                    out.append(If(tuple(branches)))
                else:
                    raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), ""

    return body()[0]


# ---- constant folding ----------------------------------------------------------------------


def _apply(op: str, *args):
    if op == "+":
        return args[0] + args[1] if type(args[0]) is type(args[1]) else str(args[0]) + str(args[1])
    if op in ("==", "!="):
        return (args[0] == args[1]) == (op == "==")
    if op == "not":
        return not args[0]
    return (args[0] and args[1]) if op == "and" else (args[0] or args[1])


def fold_expression(e: tuple) -> tuple:
    if e[0] in ("literal", "name"):
        return e
    if e[0] == "filter":
        inner = fold_expression(e[2])
        return ("literal", FILTERS[e[1]](str(inner[1]))) if inner[0] == "literal" else ("filter", e[1], inner)
    args = tuple(fold_expression(x) for x in e[1:])
    if all(a[0] == "literal" for a in args):
        return ("literal", _apply(e[0], *(a[1] for a in args)))
    return (e[0], *args)


def fold(nodes: tuple) -> tuple:
    """Evaluate what holds only literals, drop branches that cannot run, and join neighbouring texts."""
    out: list = []

    def put(node) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].value + node.value)
        elif not (isinstance(node, Text) and not node.value):
            out.append(node)

    for node in nodes:
        if isinstance(node, Output):
            value = fold_expression(node.value)
            put(Text(str(value[1])) if value[0] == "literal" else Output(value))
        elif isinstance(node, For):
            put(For(node.name, fold(node.body)))
        elif isinstance(node, Generation):
            put(Generation(fold(node.body)))
        elif isinstance(node, If):
            branches = []
            for condition, inner in node.branches:
                condition = None if condition is None else fold_expression(condition)
                if condition is not None and condition[0] == "literal":
                    if not condition[1]:
                        continue
                    condition = None
                branches.append((condition, fold(inner)))
                if condition is None:
                    break
            if branches and branches[0][0] is None:
                for inner in branches[0][1]:
                    put(inner)
            elif branches:
                put(If(tuple(branches)))
        else:
            put(node)
    return tuple(out)


# ---- code generation -----------------------------------------------------------------------

Write = Callable[[str, bool], None]


def _expression(e: tuple) -> Callable[[dict], object]:
    if e[0] == "literal":
        return lambda scope, v=e[1]: v
    if e[0] == "name":
        return lambda scope, a=e[1], b=e[2]: scope[a][b]
    if e[0] == "filter":
        return lambda scope, f=FILTERS[e[1]], x=_expression(e[2]): f(str(x(scope)))
    args = [_expression(x) for x in e[1:]]
    if e[0] == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if e[0] == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    return lambda scope, op=e[0]: _apply(op, *(a(scope) for a in args))


def _block(nodes: tuple, learn: bool = False) -> Callable[[dict, Write], None]:
    steps = []
    for node in nodes:
        if isinstance(node, Text):
            steps.append(lambda scope, write, v=node.value: write(v, learn))
        elif isinstance(node, Output):
            steps.append(lambda scope, write, x=_expression(node.value): write(str(x(scope)), learn))
        elif isinstance(node, Generation):
            steps.append(_block(node.body, True))
        elif isinstance(node, If):
            choices = [(_expression(c) if c is not None else (lambda scope: True), _block(b, learn)) for c, b in node.branches]

            def choose(scope, write, choices=choices):
                for condition, inner in choices:
                    if condition(scope):
                        inner(scope, write)
                        break

            steps.append(choose)
        else:
            raise TemplateError("loops do not nest")

    def run(scope: dict, write: Write) -> None:
        for step in steps:
            step(scope, write)

    return run


class Template:
    """A compiled template: what comes before the loop, for each message, and after the loop."""

    def __init__(self, source: str = TEMPLATE):
        tree = fold(parse(source))
        loops = [i for i, n in enumerate(tree) if isinstance(n, For)]
        if len(loops) != 1:
            raise TemplateError("one loop over messages is needed")
        loop = tree[loops[0]]
        self.name = loop.name
        self.before, self.each, self.after = _block(tree[: loops[0]]), _block(loop.body), _block(tree[loops[0] + 1 :])

    def message(self, role: str, text: str, index: int) -> list[tuple[str, bool]]:
        """The pieces of one message, with whether a model shall learn them; the closing part is ``closing()``."""
        out: list[tuple[str, bool]] = []
        write = lambda t, learn: out.append((t, learn))
        scope = {self.name: {"role": role, "text": text}, "loop": {"first": index == 0, "index": index + 1}}
        if index == 0:
            self.before({}, write)
        self.each(scope, write)
        return out

    def closing(self) -> list[tuple[str, bool]]:
        out: list[tuple[str, bool]] = []
        self.after({}, lambda t, learn: out.append((t, learn)))
        return out


# ---- on tables -----------------------------------------------------------------------------

PIECES = "conv_id long, turn_index long, formatted string, loss_from long, loss_to long"


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, turn_index, formatted, loss_from, loss_to``: the formatted text of each turn, in order.

    A conversation's text is its pieces joined in order of ``turn_index``; the last piece ends with what the template has
    after its loop. ``loss_from`` and ``loss_to`` are code points within the piece, both 0 where nothing is to be learnt.
    Pieces of a conversation stand together. Rows without conv_id are one conversation; turns without number come first,
    and equal numbers go by role and text.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        closing = "".join(t for t, _ in compiled.closing())
        held: list | None = None  # the last piece, until it is known whether its conversation goes on
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                goes_on = held is not None and conv == held[0]
                if held is not None:
                    out.append(held if goes_on else [*held[:2], held[2] + closing, *held[3:]])
                index = held[1] + 1 if goes_on else 0
                pieces = compiled.message(role, text, index)
                at, start, end = 0, 0, 0
                for t, learn in pieces:
                    if learn:
                        start, end = (start if end else at), at + len(t)
                    at += len(t)
                held = [conv, index, "".join(t for t, _ in pieces), start, end]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        if held is not None:
            held[2] += closing
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(held, kinds, strict=True)], names)

    rows = rows.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, PIECES)


_TURN = re.compile(r"<s>\[(?:INST\] (?P<user>.*) \[/INST\]|ANSWER\] (?P<answer>.*)|ROLE\] (?P<role>(?:[^\\\[]|\\.)*)\[TEXT\] (?P<text>.*))</s>\n", re.S)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a turn that the standard template formatted."""
    m = _TURN.fullmatch(formatted)
    if m["user"] is not None:
        return "user", unescape(m["user"])
    if m["answer"] is not None:
        return "assistant", unescape(m["answer"])
    return unescape(m["role"]), unescape(m["text"])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


#: A turn up to its end mark; one within a text is escaped.
_WHOLE_TURN = re.compile(r"(?:[^\\<]++|\\.|<(?!/s>\n))*+</s>\n", re.S)


def digest(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of ``format_conversations`` with the standard template.

    Turns are told by the marks in the joined text, not by the pieces' rows; text beyond the last mark is an error.
    """
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def closed() -> tuple:
            if state["rest"]:
                raise ValueError("a conversation ends within a turn")
            return (state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["learnt"].hexdigest(), state["size"])

        for batch in batches:
            out = []
            for conv, formatted, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                if state is None or conv != state["conv"]:
                    if state:
                        out.append(closed())
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "learnt": hashlib.sha256(), "size": 0, "rest": ""}
                state["size"] += len(formatted)
                learnt = unescape(formatted[start:end])
                state["chars"] += len(learnt)
                state["learnt"].update(learnt.encode("utf-8", "surrogatepass"))
                state["rest"] += formatted
                at = 0
                while m := _WHOLE_TURN.match(state["rest"], at):
                    at = m.end()
                    role, text = read_turn(m[0])
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["rest"] = state["rest"][at:]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(closed(), kinds, strict=True)], names)

    return pieces.mapInArrow(run, DIGEST)
