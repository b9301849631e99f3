"""K1: one pass over source files that turns each into fact rows; every rule after it is relational.

A row is ``(file, fact, id, parent, pos, line, depth, scope, name, value, items, text)``:

- ``import``: ``name`` bound to module ``value`` (a relative one with its dots), or to its member ``text``;
- ``scope``: function or class (``value``) of qualified ``name`` from ``line`` to ``pos``, arguments in
  ``items``, first paragraph of its docstring in ``text``;
- ``call``: dotted chain in ``value``, keyword names in ``items``, enclosing call in ``parent``, end line in
  ``pos``, block depth in ``depth``, kind or name of the first argument in ``name``;
- ``use``: a ``name`` among the arguments of call ``parent``;
- ``message``: number ``pos`` of ``parent`` with role ``name``, kind ``value`` and ``text`` (of an
  unresolved one, the name it comes from, or the function's with ``()`` where it is one's result), and the
  expression ``id`` that gives both, if it is no simple one;
- ``assign``: ``name`` set to ``value`` (call, name, literal or other), with the call's id in ``parent``, the
  name or literal in ``text``, and an expression's ``id`` as above;
- ``expr``: node ``id`` of an expression, operand ``pos`` of ``parent`` at level ``depth``: operation ``value``, or a
  leaf's kind, ``text``, variables (``items``) and ``name``;
- ``param``: keyword ``name`` of call ``parent``, its kind in ``value``, its code in ``text``, a string's value in ``items``;
- ``return``: call ``parent`` whose result the function ``scope`` returns, or a message list of id ``id`` (or one
  message of that id, with ``value`` dict);
- ``pipe``: operand ``pos`` of chain ``id`` is call ``parent``;
- ``dict``: a literal with ``items`` as keys and JSON ``text``;
- ``warning``: code in ``name``, reason in ``text``.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fact rows that leave a worker together; one file's rows are never divided.
ROWS = 5_000
#: Tasks of the pass for each core, so that one slow task does not hold up the others.
TASKS_A_CORE = 2
#: Characters of sources in a task of the pass at most on average: a task sorts all its rows by kind before it writes them.
CHARS_A_TASK = 16 << 20
COLUMNS = "file string, fact string, id string, parent string, pos int, line int, depth int, scope string, name string, value string, items array<string>, text string"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_BLOCKS = (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.AsyncFor, ast.AsyncWith)
#: Nodes without rows of their own, and without any below them.
_LEAVES = (ast.expr_context, ast.operator, ast.Name, ast.Constant, ast.alias)
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _dotted(node: ast.AST) -> str:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "()")
    return ".".join(reversed(parts))


def _slot(value: ast.AST) -> str:
    """What stands in a template for a value: a dotted name, or ``<expr>`` for anything else."""
    name = _dotted(value) if isinstance(value, ast.Name | ast.Attribute) else "()"
    return "<expr>" if name.startswith("()") else name


def _text_of(node: ast.AST) -> tuple[str, str]:
    """Kind and text of an expression that may be a message."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return "literal", node.value
    if isinstance(node, ast.JoinedStr):
        return "fstring", "".join(v.value if isinstance(v, ast.Constant) else "{" + _slot(v.value) + "}" for v in node.values)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        return "unresolved", f"{node.func.id}()"
    return "unresolved", _dotted(node) if isinstance(node, ast.Name | ast.Attribute) else ""


def _operation(node: ast.AST) -> tuple[str | None, list[ast.AST]]:
    """What an expression does with the texts of its operands, if it is one that :mod:`expressions` folds."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        operands, left = [node.right], node.left
        while isinstance(left, ast.BinOp) and isinstance(left.op, ast.Add):
            operands.append(left.right)
            left = left.left
        return "concat", [left, *reversed(operands)]
    method = node.func.attr if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) else None
    if method == "dedent" and len(node.args) == 1 and not node.keywords:
        return "wrap", [node.args[0]]
    if method in ("strip", "lstrip", "rstrip") and isinstance(node.func, ast.Attribute):
        return "wrap", [node.func.value]
    if method == "format" and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Constant) and isinstance(node.func.value.value, str):
        return "format", []
    return None, []


class _Facts(ast.NodeVisitor):
    def __init__(self, file: str):
        self.file, self.rows, self.scope, self.depth, self.inside, self.nodes = file, [], [], 0, [], 0

    def add(self, fact: str, node: ast.AST | None = None, **kw) -> None:
        base = dict.fromkeys(_NAMES) | {"file": self.file, "fact": fact, "line": getattr(node, "lineno", None), "depth": self.depth, "scope": ".".join(self.scope)}
        self.rows.append(base | kw)

    def ident(self, node: ast.AST) -> str:
        return f"{self.file}:{node.lineno}:{node.col_offset}:{node.end_col_offset}"

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", node, name=a.asname or a.name.split(".")[0], value=a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", node, name=a.asname or a.name, value="." * node.level + (node.module or ""), text=a.name)

    def visit_scope(self, node) -> None:
        doc = (ast.get_docstring(node) or "").split("\n\n")[0]
        args = [] if isinstance(node, ast.ClassDef) else [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]]
        self.scope.append(node.name)
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        self.add("scope", node, name=".".join(self.scope), value=kind, pos=node.end_lineno, items=args, text=doc)
        kept, self.depth = self.depth, 0
        self.generic_visit(node)
        self.depth = kept
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = visit_scope

    def generic_visit(self, node: ast.AST) -> None:
        block = isinstance(node, _BLOCKS)
        self.depth += block
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, _LEAVES):
                self.visit(child)
        self.depth -= block

    def expression(self, node: ast.AST, parent: str | None = None, pos: int = 0, level: int = 0) -> str:
        """Rows of a node and its operands; its id."""
        self.nodes += 1
        me = f"{self.file}#{self.nodes}"
        what, operands = _operation(node)
        kind, text = _text_of(node)
        if what == "format":
            text = node.func.value.value
        elif what or kind == "unresolved":
            text = None
        names = list(dict.fromkeys(s for v in node.values if isinstance(v, ast.FormattedValue) and (s := _slot(v.value)) != "<expr>")) if isinstance(node, ast.JoinedStr) else None
        self.add("expr", node, id=me, parent=parent, pos=pos, depth=level, name=node.id if isinstance(node, ast.Name) else None, value=what or kind, text=text, items=names)
        for k, operand in enumerate(operands):
            self.expression(operand, me, k, level + 1)
        return me

    def blocks(self, node: ast.List) -> str:
        """Rows of a list of content blocks: texts, and placeholders of all others."""
        self.nodes += 1
        me = f"{self.file}#{self.nodes}"
        self.add("expr", node, id=me, pos=0, depth=0, value="blocks")
        for k, item in enumerate(node.elts):
            fields = {f.value: v for f, v in zip(item.keys, item.values, strict=True) if isinstance(f, ast.Constant)} if isinstance(item, ast.Dict) else {}
            kind = fields["type"].value if isinstance(fields.get("type"), ast.Constant) else None
            if "text" in fields and (not kind or kind == "text"):
                self.expression(fields["text"], me, k, 1)
            else:
                self.nodes += 1
                held = f"<{kind}>" if kind and kind != "text" else None
                self.add("expr", node, id=f"{self.file}#{self.nodes}", parent=me, pos=k, depth=1, value="unresolved", text=held)
        return me

    def folded(self, node: ast.AST) -> str | None:
        return self.expression(node) if _operation(node)[0] else None

    def messages(self, owner: str, node: ast.AST) -> None:
        if not isinstance(node, ast.List):
            kind, text = _text_of(node)
            self.add("message", node, id=self.folded(node), parent=owner, pos=0, name="user", value=kind, text=text)
            return
        if not node.elts:
            self.add("message", node, parent=owner, pos=0, name="user", value="unresolved", text="")
        for pos, item in enumerate(node.elts):
            fields = {k.value: v for k, v in zip(item.keys, item.values, strict=True) if isinstance(k, ast.Constant)} if isinstance(item, ast.Dict) else {}
            if isinstance(item, ast.Tuple) and len(item.elts) == 2:
                fields = dict(zip(("role", "content"), item.elts))
            role = fields["role"].value if isinstance(fields.get("role"), ast.Constant) else "user"
            content = fields.get("content", item)
            kind, text = _text_of(content)
            self.add("message", item, id=self.folded(content), parent=owner, pos=pos + 1, name=str(role), value=kind, text=text)

    def params(self, call: str, keywords: list[ast.keyword]) -> None:
        for pos, k in enumerate(keywords):
            if not k.arg:
                continue
            v, held = k.value, None
            kind, code = "code", ast.unparse(v)
            if isinstance(v, ast.Constant):
                kind, code = type(v.value).__name__, repr(v.value)
                held = [v.value] if kind == "str" else None
            elif isinstance(v, ast.UnaryOp) and isinstance(v.op, ast.USub) and isinstance(v.operand, ast.Constant) and type(v.operand.value) in (int, float):
                kind = "negative"
            elif isinstance(v, ast.Dict):
                kind = "dict"
                held = [t.value for f, t in zip(v.keys, v.values, strict=True) if isinstance(f, ast.Constant) and f.value == "type" and isinstance(t, ast.Constant) and isinstance(t.value, str)][:1]
            self.add("param", v, parent=call, pos=pos, name=k.arg, value=kind, text=code, items=held)

    def visit_Call(self, node: ast.Call) -> None:
        me, first = self.ident(node), node.args[0] if node.args else None
        keys = {k.arg: k.value for k in node.keywords if k.arg}
        shape = "list" if isinstance(first, ast.List) else f"name:{first.id}" if isinstance(first, ast.Name) else None
        self.add("call", node, id=me, parent=self.inside[-1] if self.inside else None, pos=node.end_lineno, name=shape, value=_dotted(node.func), items=list(keys))
        before = len(self.rows)
        if "system" in keys:
            kind, text = _text_of(keys["system"])
            held = keys["system"]
            root = self.folded(held) if not isinstance(held, ast.List) else self.blocks(held) if held.elts else None
            if root or not isinstance(held, ast.List):
                self.add("message", node, id=root, parent=me, pos=-1, name="system", value=kind, text=text)
        for k in ("messages", "input", "prompt"):
            if k in keys:
                self.messages(me, keys[k])
                break
        else:
            if isinstance(first, ast.List | ast.Name | ast.Constant | ast.JoinedStr):
                self.messages(me, first)
        if len(self.rows) > before:
            self.params(me, node.keywords)
        for arg in [*node.args, *keys.values()]:
            for n in ast.walk(arg):
                if isinstance(n, ast.Name):
                    self.add("use", node, parent=me, name=n.id)
        self.inside.append(me)
        self.generic_visit(node)
        self.inside.pop()

    def bind(self, node: ast.AST, target: ast.AST, value: ast.AST | None) -> None:
        if value is None or not isinstance(target, ast.Name | ast.Attribute):
            return
        value = value.value if isinstance(value, ast.Await) else value
        kind, text = _text_of(value)
        call = self.ident(value) if isinstance(value, ast.Call) else None
        what = "call" if call else "name" if isinstance(value, ast.Name) else kind if kind != "unresolved" else "other"
        self.add("assign", node, id=self.folded(value), name=_dotted(target), parent=call, value=what, text=_dotted(value.func) if call else text)

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            self.bind(node, target, node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.bind(node, node.target, node.value)
        self.generic_visit(node)

    def visit_Return(self, node: ast.Return) -> None:
        value = node.value.value if isinstance(node.value, ast.Await) else node.value
        if isinstance(value, ast.Call):
            self.add("return", node, parent=self.ident(value))
        elif isinstance(value, ast.Name):
            self.add("return", node, name=value.id)
        elif isinstance(value, ast.List | ast.Constant | ast.JoinedStr):
            self.add("return", node, id=self.ident(value))
            self.messages(self.ident(value), value)
        elif isinstance(value, ast.Dict) and {"role", "content"} <= {k.value for k in value.keys if isinstance(k, ast.Constant)}:
            self.add("return", node, id=self.ident(value), value="dict")
            self.messages(self.ident(value), ast.List(elts=[value]))
        self.generic_visit(node)

    def visit_BinOp(self, node: ast.BinOp) -> None:
        parts, left = [], node
        while isinstance(left, ast.BinOp) and isinstance(left.op, ast.BitOr):
            parts.append(left.right)
            left = left.left
        for pos, part in enumerate(reversed([*parts, left])) if parts else ():
            if isinstance(part, ast.Call):
                self.add("pipe", node, id=self.ident(node), parent=self.ident(part), pos=pos)
        for part in [left, *parts] if parts else [node.left, node.right]:
            self.visit(part)

    def visit_Dict(self, node: ast.Dict) -> None:
        try:
            value = ast.literal_eval(node)
            text = json.dumps(value, ensure_ascii=False, allow_nan=False) if all(isinstance(k, str) for k in value) else None
        except (ValueError, TypeError, SyntaxError):
            text = None
        if text and value:
            self.add("dict", node, items=list(value), text=text)
        self.generic_visit(node)


def file_facts(file: str, content: str | None) -> list[dict]:
    """One file's rows; a file that does not parse gives a warning alone."""
    facts = _Facts(file)
    try:
        facts.visit(ast.parse(content or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        facts.rows.clear()
        facts.add("warning", name="W001-unparseable", text=type(e).__name__)
    return facts.rows


def extract_facts(files: DataFrame) -> DataFrame:
    """K1: fact rows of ``(file, content)``; write them once, partitioned by ``fact``, before applying rules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                held += file_facts(file, content)
                if len(held) >= ROWS:
                    yield _frame(held)
                    held = []
        if held:
            yield _frame(held)

    # Dealt anew: parsing costs far more than moving a file, and one large table file may hold many sources. The number
    # is given, as adaptive execution would else put these few bytes into one task, and grows with the sources.
    chars = files.agg(F.sum(F.length("content"))).first()[0] or 0
    tasks = max(TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism, -(-chars // CHARS_A_TASK))
    return files.select("file", "content").repartition(tasks, "file").mapInPandas(run, COLUMNS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"pos": "Int32", "line": "Int32", "depth": "Int32"})
