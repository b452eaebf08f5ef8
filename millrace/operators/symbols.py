"""Definitions that calls name across the files of a repository.

One pass over the syntax trees gives a symbol table: definitions, names that imports bind, star
imports and base classes. What a call names is a dotted reference that begins in its module; it is
resolved in rounds, each a join that puts the target in place of the longest bound prefix, for all
references of all repositories at once. Methods then come from the class named or the nearest of
its ancestors, whose table is closed by joins as well. References are resolved once however many
calls share them.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .graph import _checkpoint
from .pyast import _tree, dotted, python_files

_FACTS = {"kind": "string", "module": "string", "name": "string", "target": "string", "above": "boolean", "line": "int", "place": "int"}
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}


def module_of(path: str, roots: tuple[str, ...] = ("src",)) -> str:
    """pkg.mod of /src/pkg/mod.py, pkg of pkg/__init__.py; a leading folder of roots doesn't count."""
    parts = [p for p in path.removesuffix(".py").split("/") if p]
    if len(parts) > 1 and parts[0] in roots:
        parts = parts[1:]
    return ".".join(parts[:-1] if parts[-1:] == ["__init__"] else parts)


class _Scope:
    """Names that a function binds: parameters and assigned names to None, imports and definitions to what they name."""

    def __init__(self, node: ast.AST, full: str, imported) -> None:
        self.names: dict[str, str | None] = {}
        args = node.args
        for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]:
            self.names[a.arg] = None
        first = [*args.posonlyargs, *args.args]
        self.first = first[0].arg if first else None
        todo = list(node.body)
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.names[x.name] = f"{full}.{x.name}"
                continue
            if isinstance(x, (ast.Import, ast.ImportFrom)):
                self.names.update((n, t) for n, t in imported(x) if n != "*")
            elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                self.names[x.id] = None
            todo += ast.iter_child_nodes(x)


def symbol_facts(content: str | None, path: str) -> list[dict]:
    """Rows of kind module, def, bind, star, base, call and error of one file."""
    module = module_of(path)
    tree = _tree(content)
    out: list[dict] = []

    def add(kind: str, **values) -> None:
        out.append(dict.fromkeys(_FACTS) | {"kind": kind, "module": module} | values)

    if tree is None:
        add("error")
        return out
    add("module", name=module, line=1)
    package = module if path.endswith("__init__.py") else module.rpartition(".")[0]

    def imported(node: ast.Import | ast.ImportFrom) -> list[tuple[str, str]]:
        if isinstance(node, ast.Import):
            return [(a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0]) for a in node.names]
        source = node.module or ""
        if node.level:
            parts = package.split(".") if package else []
            source = ".".join([*parts[: len(parts) - node.level + 1], *filter(None, [source])])
        return [(a.asname or a.name, source if a.name == "*" else f"{source}.{a.name}" if source else a.name) for a in node.names]

    def reference(text: str, scopes: list[_Scope], owner: str | None) -> str | None:
        """Where a dotted text begins: a local name, the class of the method's own object, or the module."""
        head, _, rest = text.partition(".")
        for depth, scope in enumerate(reversed(scopes)):
            if head in scope.names:
                if owner and depth == len(scopes) - 1 and head == scope.first and rest:
                    return f"{owner}.{rest}"
                target = scope.names[head]
                return None if target is None else f"{target}.{rest}" if rest else target
        return f"{module}.{text}"

    def walk(node: ast.AST, full: str, scopes: list[_Scope], owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = f"{full}.{child.name}"
                add("def", name=own, target="method" if full == owner else "function", line=child.lineno)
                for extra in [*child.decorator_list, *child.args.defaults, *filter(None, child.args.kw_defaults)]:
                    walk(ast.Expr(extra), full, scopes, owner)
                body = ast.Module(child.body, [])
                walk(body, own, [*scopes, _Scope(child, own, imported)], owner)
            elif isinstance(child, ast.ClassDef):
                own = f"{full}.{child.name}"
                add("def", name=own, target="class", line=child.lineno)
                for k, b in enumerate(child.bases):
                    if dotted(b):
                        add("base", name=own, target=reference(dotted(b), scopes, owner), place=k, line=child.lineno)
                for extra in [*child.decorator_list, *child.bases]:
                    walk(ast.Expr(extra), full, scopes, owner)
                walk(ast.Module(child.body, []), own, scopes, own)
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    text = dotted(f)
                    up = isinstance(f, ast.Attribute) and isinstance(f.value, ast.Call) and dotted(f.value.func) == "super"
                    if text:
                        add("call", name=full, target=reference(text, scopes, owner), above=False, line=child.lineno, place=child.col_offset)
                    elif up and owner:
                        add("call", name=full, target=f"{owner}.{f.attr}", above=True, line=child.lineno, place=child.col_offset)
                elif isinstance(child, (ast.Import, ast.ImportFrom)) and not scopes:
                    for name, target in imported(child):
                        add("star" if name == "*" else "bind", name=f"{module}.{name}", target=target, line=child.lineno)
                walk(child, full, scopes, owner)

    walk(tree, module, [], None)
    return out


def file_symbols(files: DataFrame) -> DataFrame:
    """symbol_facts of every Python file, with its repo_id and path."""
    ship(files.sparkSession)
    schema = pa.schema([("repo_id", pa.string()), ("path", pa.string())] + [(k, _ARROW[t]) for k, t in _FACTS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for r, p, c in zip(*(b.column(k).to_pylist() for k in ("repo_id", "path", "content")), strict=True):
                rows += [{"repo_id": r, "path": p} | x for x in symbol_facts(c, p)]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return python_files(files).mapInArrow(run, "repo_id string, path string, " + ", ".join(f"{k} {t}" for k, t in _FACTS.items()))


def definitions(symbols: DataFrame) -> DataFrame:
    """repo_id, name, kind, path and line of every definition; of a name defined again, the last."""
    last = F.max_by(F.struct(F.col("target").alias("kind"), "path", "line"), F.struct("line", "path")).alias("d")
    return symbols.where("kind = 'def'").groupBy("repo_id", "name").agg(last).select("repo_id", "name", "d.*")


def bindings(symbols: DataFrame) -> DataFrame:
    """repo_id, name (module.bound) and target of the names that imports bind; a later definition or import takes a name over.

    A star import binds the public names that its module defines or binds itself, star imports included.
    """
    own = symbols.where("kind IN ('bind', 'def')").select("repo_id", "module", "name", F.when(F.col("kind") == "bind", F.col("target")).alias("target"), "line")
    own = own.where(F.expr("substring_index(name, '.', -1) = substring(name, length(module) + 2)"))  # top level
    last = own.groupBy("repo_id", "module", "name").agg(F.max_by("target", "line").alias("target"))
    last = _checkpoint(last)
    stars = _checkpoint(symbols.where("kind = 'star'").select("repo_id", "module", F.col("target").alias("source")).distinct())
    bound, new = last, last
    while not stars.isEmpty():
        names = new.select("repo_id", F.col("module").alias("source"), "name")
        public = names.join(stars, ["repo_id", "source"]).select("repo_id", "module", F.expr("substring(name, length(source) + 2)").alias("short"), "name")
        public = public.where(~F.col("short").startswith("_") & ~F.col("short").contains("."))
        found = public.select("repo_id", "module", F.concat_ws(".", "module", "short").alias("name"), F.col("name").alias("target"))
        found = found.groupBy("repo_id", "module", "name").agg(F.min("target").alias("target"))
        new = _checkpoint(found.join(bound.select("repo_id", "name"), ["repo_id", "name"], "left_anti").select("repo_id", "module", "name", "target"))
        if new.isEmpty():
            break
        bound = _checkpoint(bound.union(new))
    return bound.where("target IS NOT NULL AND target <> name").select("repo_id", "name", "target")


def _prefixes(ref: Column) -> Column:
    """All prefixes of a dotted name, itself included."""
    parts = F.split(ref, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def resolve(refs: DataFrame, bound: DataFrame) -> DataFrame:
    """repo_id, ref and now: each reference with its bound prefixes put in place until none is left.

    The longest bound prefix goes first. A reference that comes back to a form it had (imports in a circle) stays as it is then.
    """
    state = refs.select("repo_id", "ref", F.col("ref").alias("now"), F.array("ref").alias("seen"))
    done = None
    while True:
        each = state.select("repo_id", "ref", "now", "seen", F.explode(_prefixes(F.col("now"))).alias("name"))
        hit = each.join(bound, ["repo_id", "name"]).groupBy("repo_id", "ref").agg(F.max_by(F.struct("name", "target"), F.length("name")).alias("b"))
        rest = F.expr("substring(now, length(b.name) + 1)")
        state = _checkpoint(state.join(hit, ["repo_id", "ref"], "left").withColumn("new", F.concat("b.target", rest)))
        moves = F.col("new").isNotNull() & ~F.array_contains("seen", F.col("new"))
        settled = state.where(~F.coalesce(moves, F.lit(False))).select("repo_id", "ref", "now")
        done = settled if done is None else done.union(settled)
        state = state.where(moves).select("repo_id", "ref", F.col("new").alias("now"), F.concat("seen", F.array("new")).alias("seen"))
        if state.isEmpty():
            return done


def ancestors(symbols: DataFrame, bound: DataFrame, defined: DataFrame) -> DataFrame:
    """repo_id, cls, ancestor and place: each class's ancestors that the repository defines, itself first.

    place sorts them as methods are looked up: bases from left to right, each after its own
    subclasses (the last place of an ancestor reached on several ways counts).
    """
    bases = symbols.where("kind = 'base' AND target IS NOT NULL").select("repo_id", F.col("name").alias("cls"), F.col("target").alias("ref"), "place")
    classes = defined.where("kind = 'class'").select("repo_id", F.col("name"))
    known = resolve(bases.select("repo_id", "ref").distinct(), bound)
    edges = bases.join(known, ["repo_id", "ref"]).join(classes.withColumnRenamed("name", "now"), ["repo_id", "now"])
    edges = _checkpoint(edges.select("repo_id", F.col("cls").alias("ancestor"), F.col("now").alias("base"), F.col("place").alias("k")))
    every = classes.select("repo_id", F.col("name").alias("cls"), F.col("name").alias("ancestor"), F.expr("cast(array() AS array<int>)").alias("place"), F.array("name").alias("way"))
    new = every
    while True:
        grown = new.join(edges, ["repo_id", "ancestor"]).where(~F.array_contains("way", F.col("base")))
        grown = grown.select("repo_id", "cls", F.col("base").alias("ancestor"), F.concat("place", F.array("k")).alias("place"), F.concat("way", F.array("base")).alias("way"))
        last = F.max_by(F.struct("place", "way"), "place").alias("p")
        new = _checkpoint(grown.groupBy("repo_id", "cls", "ancestor").agg(last).select("repo_id", "cls", "ancestor", "p.*"))
        if new.isEmpty():
            break
        every = every.union(new)
    return every.groupBy("repo_id", "cls", "ancestor").agg(F.max("place").alias("place"))


def calls(files: DataFrame) -> DataFrame:
    """Every call with the definition that it names.

    repo_id, path, caller, line, place (column), ref, status, callee, callee_path, callee_line.
    status: definition, builtin, external (a name that comes from no module of the repository), local (a value of
    the function's own) or unresolved. Files that don't parse have no calls.
    """
    symbols = _checkpoint(file_symbols(files))
    defined, bound = _checkpoint(definitions(symbols)), _checkpoint(bindings(symbols))
    made = symbols.where("kind = 'call'").select("repo_id", "path", "module", F.col("name").alias("caller"), F.col("target").alias("ref"), "above", "line", "place")
    refs = _checkpoint(resolve(made.where("ref IS NOT NULL").select("repo_id", "ref").distinct(), bound))
    exact = refs.join(defined.withColumnRenamed("name", "now"), ["repo_id", "now"]).select("repo_id", "ref", F.lit(False).alias("above"), F.struct(F.col("now").alias("callee"), "path", "line").alias("d"))
    # a method of the class named before the last dot, or of its nearest ancestor that has it
    method = refs.select("repo_id", "ref", F.expr("substring_index(now, '.', -1)").alias("attr"), F.expr("left(now, length(now) - length(substring_index(now, '.', -1)) - 1)").alias("cls"))
    lines = ancestors(symbols, bound, defined)
    reached = method.join(lines, ["repo_id", "cls"]).withColumn("name", F.concat_ws(".", "ancestor", "attr"))
    reached = reached.join(defined, ["repo_id", "name"]).select("repo_id", "ref", "place", F.size("place").alias("n"), F.struct(F.col("name").alias("callee"), "path", "line").alias("d"))
    above = F.explode(F.when(F.col("n") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("above")
    inherited = reached.select("repo_id", "ref", "place", "d", above).groupBy("repo_id", "ref", "above").agg(F.min_by("d", "place").alias("d"))
    found = exact.union(inherited.select("repo_id", "ref", "above", "d")).groupBy("repo_id", "ref", "above").agg(F.max("d").alias("d"))
    roots = symbols.where("kind = 'module'").select("repo_id", F.split_part("module", F.lit("."), F.lit(1)).alias("root"), F.lit(True).alias("own")).distinct()
    state = refs.withColumn("root", F.split_part("now", F.lit("."), F.lit(1))).join(roots, ["repo_id", "root"], "left")
    state = state.select("repo_id", "ref", "now", F.coalesce("own", F.lit(False)).alias("own"))
    rows = made.join(state, ["repo_id", "ref"], "left").join(found, ["repo_id", "ref", "above"], "left")
    short = F.expr("substring(now, length(module) + 2)")
    named = F.col("now").startswith(F.concat("module", F.lit("."))) & short.isin(*sorted(n for n in dir(builtins) if not n.startswith("_")))
    status = (
        F.when(F.col("d").isNotNull(), "definition").when(F.col("ref").isNull(), "local").when(~F.col("own"), "external").when(named, "builtin")
        .otherwise("unresolved")
    )
    return rows.select(
        "repo_id", "path", "caller", "line", "place", "ref", status.alias("status"), "d.callee", F.col("d.path").alias("callee_path"), F.col("d.line").alias("callee_line")
    )
