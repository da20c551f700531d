"""Python files, by the standard library's parser."""

from __future__ import annotations

import ast
import io
import tokenize

from ripplemark.functions.extract.facts import Facts, Function, Hit, Import, fingerprint

#: Fixed: decorator attributes that register a route, and the method they stand for.
ROUTES = {
    "get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "head": "HEAD",
    "options": "OPTIONS", "route": "ANY", "api_route": "ANY", "websocket": "WS",
}
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_FUNCTIONS = (*_DEFS, ast.Lambda)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)


def _parse(text: str) -> ast.Module:
    """The tree; lines that no parser takes are left out, a bounded number of them."""
    lines = text.replace("\x00", "").split("\n")
    for _ in range(50):
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as e:
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            while at > 0 and not lines[at].strip():
                at -= 1
            indent = len(lines[at]) - len(lines[at].lstrip())
            filler = lines[at][:indent] + "pass"
            lines[at] = "" if lines[at].strip() == "pass" or not lines[at].strip() else filler
        except (ValueError, RecursionError, MemoryError):
            break
    return ast.Module([], [])


def _comments(text: str) -> dict[int, int]:
    """Column of the comment of each line that has one."""
    found = {}
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                found[t.start[0]] = t.start[1]
    except (tokenize.TokenError, SyntaxError):
        pass
    return found


class _Source:
    def __init__(self, text: str):
        self.lines, self.comments = text.split("\n"), _comments(text)

    def code(self, node: ast.AST) -> str:
        """A node's source without comments."""
        out = []
        for n in range(node.lineno, node.end_lineno + 1):
            raw = self.lines[n - 1] if n <= len(self.lines) else ""
            line = raw.encode()
            a = node.col_offset if n == node.lineno else 0
            z = node.end_col_offset if n == node.end_lineno else len(line)
            cut = self.comments.get(n)
            if cut is not None:
                z = min(z, len(raw[:cut].encode()))
            out.append(line[a:z].decode("utf-8", "replace"))
        return "\n".join(out)


def _callee(node: ast.AST) -> str | None:
    """``f``, ``a.b.f``; a call in the chain reads ``f(...)``; null for what has no name."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        owner = _callee(node.value)
        return owner and f"{owner}.{node.attr}"
    if isinstance(node, ast.Call):
        inner = _callee(node.func)
        return inner and f"{inner}(...)"
    return None


def _is_class_name(dotted: str) -> bool:
    return dotted.rsplit(".", 1)[-1][:1].isupper() and all(c.isalnum() or c in "_." for c in dotted)


def _annotated_class(node: ast.AST | None) -> str | None:
    """The class an annotation names; containers and lower-case names give none."""
    if isinstance(node, (ast.Name, ast.Attribute)):
        named = _callee(node)
    elif isinstance(node, ast.Constant) and isinstance(node.value, str):
        named = node.value.strip()
    elif isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "Optional":
        return _annotated_class(node.slice)
    elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        sides = [s for s in (node.left, node.right) if not (isinstance(s, ast.Constant) and s.value is None)]
        return _annotated_class(sides[0]) if len(sides) == 1 else None
    else:
        return None
    return named if named and _is_class_name(named) else None


def _constructed_class(node: ast.AST | None, env: dict[str, str]) -> str | None:
    if isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
        named = _callee(node.func)
        return named if named and named.rsplit(".", 1)[-1][:1].isupper() else None
    return env.get(node.id) if isinstance(node, ast.Name) else None


def _assigned(body: list[ast.stmt], env: dict[str, str], of_self: bool) -> None:
    """Adds the classes that names (or with ``of_self`` attributes of self) are given, nested definitions aside."""
    for stmt in body:
        if isinstance(stmt, (*_DEFS, ast.ClassDef)):
            continue
        if isinstance(stmt, (ast.Assign, ast.AnnAssign)):
            targets = stmt.targets if isinstance(stmt, ast.Assign) else [stmt.target]
            target = targets[0]
            if not of_self and isinstance(target, ast.Name):
                key = target.id
            elif of_self and isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                key = f"self.{target.attr}"
            else:
                continue
            stated = _annotated_class(stmt.annotation) if isinstance(stmt, ast.AnnAssign) else None
            if held := stated or _constructed_class(stmt.value, env):
                env[key] = held
        for name in ("body", "orelse", "finalbody"):
            _assigned(getattr(stmt, name, None) or [], env, of_self)
        for part in (*getattr(stmt, "handlers", ()), *getattr(stmt, "cases", ())):
            _assigned(part.body, env, of_self)


def _own_env(node: ast.AST) -> dict[str, str]:
    args = node.args
    env = {}
    for a in (*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg):
        if a is not None and (held := _annotated_class(a.annotation)):
            env[a.arg] = held
    if isinstance(node, _DEFS):
        _assigned(node.body, env, False)
    return env


def _class_env(node: ast.ClassDef) -> dict[str, str]:
    env = {}
    for stmt in node.body:
        if isinstance(stmt, ast.AnnAssign) and isinstance(stmt.target, ast.Name):
            if held := _annotated_class(stmt.annotation):
                env[f"self.{stmt.target.id}"] = held
        elif isinstance(stmt, _DEFS):
            local = _own_env(stmt)
            _assigned(stmt.body, local, True)
            env |= {k: v for k, v in local.items() if k.startswith("self.")}
    return env


def typed(call: str, env: dict[str, str]) -> str:
    """A call written on the class of what it is made on, where the code says which."""
    made, dot, rest = call.partition("(...).")
    if dot and "(" not in made and made.rsplit(".", 1)[-1][:1].isupper():
        return f"{made}.{rest}"
    parts = call.split(".", 2)
    if len(parts) < 2:
        return call
    if parts[0] in ("self", "cls"):
        if parts[0] == "self" and len(parts) == 3 and f"self.{parts[1]}" in env:
            return f"{env[f'self.{parts[1]}']}.{parts[2]}"
        return f"{env[parts[0]]}.{parts[1]}" if len(parts) == 2 and parts[0] in env else call
    return f"{env[parts[0]]}.{call[len(parts[0]) + 1 :]}" if parts[0] in env else call


def _route(node: ast.AST) -> str | None:
    for d in node.decorator_list:
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTES):
            continue
        verb = ROUTES[d.func.attr]
        path = next((a.value for a in d.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
        if path is None:
            continue
        if verb == "ANY":
            listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
            names = [e.value.upper() for e in getattr(listed, "elts", []) if isinstance(e, ast.Constant) and isinstance(e.value, str)]
            verb = names[0] if len(names) == 1 else verb
        if path.startswith("/"):
            return f"{verb} {path}"
    return None


class _Walk:
    def __init__(self, source: _Source):
        self.source, self.facts, self.envs = source, Facts(), []

    def visit(self, node: ast.AST, enclosing: int | None, owner: tuple[str, dict] | None = None, named: str | None = None) -> None:
        if isinstance(node, _FUNCTIONS):
            return self.function(node, enclosing, owner, named)
        if isinstance(node, ast.ClassDef):
            for d in node.decorator_list:
                self.visit(d, enclosing)
            env = _class_env(node)
            for stmt in node.body:
                self.visit(stmt, enclosing, (node.name, env))
            for base in (*node.bases, *(k.value for k in node.keywords)):
                self.visit(base, enclosing)
            return None
        if isinstance(node, ast.Call) and (text := _callee(node.func)):
            if enclosing is None:
                self.facts.module_calls.append((text, node.lineno))
            else:
                self.facts.functions[enclosing].calls.append((typed(text, self.envs[enclosing]), node.lineno))
        for child in ast.iter_child_nodes(node):
            name = None
            if isinstance(child, ast.Lambda):
                if isinstance(node, ast.keyword):
                    name = node.arg
                elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                    name = node.targets[0].id
                elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                    name = node.target.id
            self.visit(child, enclosing, None, name)
        return None

    def function(self, node, enclosing, owner, named) -> None:
        is_lambda = isinstance(node, ast.Lambda)
        for d in [] if is_lambda else node.decorator_list:
            self.visit(d, enclosing)
        name = named if is_lambda else f"{owner[0]}.{node.name}" if owner else node.name
        start = min([node.lineno, *(d.lineno for d in ([] if is_lambda else node.decorator_list))])
        me = len(self.facts.functions)
        exported = enclosing is None and owner is None and bool(name) and not name.startswith("_")
        self.facts.functions.append(
            Function(
                enclosing, name, exported, bool(owner) and not is_lambda, start, node.end_lineno,
                fingerprint(self.source.code(node)), None if is_lambda else _route(node),
            )
        )
        env = dict(self.envs[enclosing]) if enclosing is not None else {}
        if owner and not is_lambda:
            env |= owner[1] | {"self": owner[0], "cls": owner[0]}
        self.envs.append(env | _own_env(node))
        self.visit(node.args, me)
        for child in [node.body] if is_lambda else node.body:
            self.visit(child, me)
        if not is_lambda and node.returns is not None:
            self.visit(node.returns, me)


def _stops(body: list[ast.stmt]) -> bool:
    """Whether a loop's body can leave the loop early."""

    def leaves(node: ast.AST, inner: bool) -> bool:
        if isinstance(node, (ast.Return, ast.Raise)) or isinstance(node, ast.Break) and not inner:
            return True
        return any(
            leaves(c, inner or isinstance(c, _LOOPS)) for c in ast.iter_child_nodes(node) if not isinstance(c, _FUNCTIONS)
        )

    return any(leaves(s, isinstance(s, _LOOPS)) for s in body if not isinstance(s, _FUNCTIONS))


def _hits(tree: ast.Module) -> list[Hit]:
    out: list[Hit] = []

    def walk(node: ast.AST, loop, way_out: bool) -> None:
        """``loop``: body of the loop around, or None; ``way_out``: what is here runs at most once."""
        if isinstance(node, ast.Await):
            per = loop is not None and not way_out
            out.append(Hit("await", node.lineno, per, per and _stops(loop)))
        if isinstance(node, _FUNCTIONS):
            loop, way_out = None, False
        if isinstance(node, (ast.Return, ast.Raise)) and loop is not None:
            way_out = True
        for name, value in ast.iter_fields(node):
            values = value if isinstance(value, list) else [value]
            body_of_loop = isinstance(node, _LOOPS) and name == "body"
            for i, child in enumerate(values):
                if not isinstance(child, ast.AST):
                    continue
                if body_of_loop and isinstance(node, ast.AsyncFor):
                    inner, out_here = None, False
                elif body_of_loop:
                    inner, out_here = value, False
                else:
                    inner, out_here = loop, way_out
                if isinstance(child, ast.stmt) and inner is not None and i + 1 < len(values) and isinstance(values[i + 1], (ast.Return, ast.Raise, ast.Break)):
                    out_here = True
                walk(child, inner, out_here)

    walk(tree, None, False)
    return sorted(out, key=lambda h: h.line)


def _imports(tree: ast.Module) -> list[Import]:
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                first = a.name.split(".")[0]
                out.append(Import(a.asname, a.name, "namespace") if a.asname else Import(first, first, "namespace"))
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            out += [Import(a.asname or a.name, module, "named", a.name) for a in node.names if a.name != "*"]
            out += [Import(None, module, "named", None) for a in node.names if a.name == "*"]
    return out


def join(module: str, name: str) -> str:
    """A module's part as a module path."""
    return f"{module}{name}" if module.endswith(".") else f"{module}.{name}"


def extract(text: str) -> Facts:
    tree = _parse(text)
    walk = _Walk(_Source(text))
    for stmt in tree.body:
        walk.visit(stmt, None)
    facts = walk.facts
    facts.imports = _imports(tree)
    for i in facts.imports:
        facts.specifiers += ([join(i.specifier, i.imported)] if i.imported else []) + [i.specifier]
    facts.hits = _hits(tree)
    return facts
