"""Class names, packages, supertypes and stubs from Java sources and class files, as index definitions.

Class files are read by the layout of the Java Virtual Machine Specification, chapter 4. Sources are scanned for type
declarations with their braces, comments and literals respected; nothing is resolved or compiled.
"""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.text import package_name
from ..operators.index import IndexDefinition, python_extractor

PUBLIC = 0x1
STUB = "name string, super_name string, interfaces array<string>, flags int, signature string, source_file string, fields array<struct<name:string,descriptor:string,signature:string,access_flags:int>>, methods array<struct<name:string,descriptor:string,signature:string,access_flags:int>>"


@dataclass
class ClassFile:
    name: str
    super_name: str | None
    interfaces: list[str]
    flags: int
    signature: str | None = None
    source_file: str | None = None
    fields: list[dict] = field(default_factory=list)
    methods: list[dict] = field(default_factory=list)

    def stub(self) -> dict:
        return dict(self.__dict__)


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, fmt: str):
        out = struct.unpack_from(">" + fmt, self.raw, self.at)
        self.at += struct.calcsize(">" + fmt)
        return out[0] if len(out) == 1 else out


#: Bytes after the tag of each kind of constant; text (1) says its own length, 5 and 6 take two places.
_CONSTANT = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}


def parse_class(raw: bytes) -> ClassFile:
    r = _Reader(bytes(raw))
    if r.take("I") != 0xCAFEBABE:
        raise ValueError("not a class file")
    r.take("HH")
    pool: dict[int, object] = {}
    k, n = 1, r.take("H")
    while k < n:
        tag = r.take("B")
        if tag == 1:
            size = r.take("H")
            pool[k] = r.raw[r.at : r.at + size].replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
            r.at += size
        elif tag in _CONSTANT:
            if tag == 7:
                pool[k] = struct.unpack_from(">H", r.raw, r.at)[0]
            r.at += _CONSTANT[tag]
        else:
            raise ValueError(f"constant of kind {tag}")
        k += 2 if tag in (5, 6) else 1
    cls = lambda i: pool[pool[i]] if i else None
    flags, this, sup, count = r.take("HHHH")
    out = ClassFile(cls(this), cls(sup), [cls(r.take("H")) for _ in range(count)], flags)

    def attributes() -> dict:
        found = {}
        for _ in range(r.take("H")):
            name, size = r.take("HI")
            if pool[name] in ("Signature", "SourceFile"):
                found[pool[name]] = pool[struct.unpack_from(">H", r.raw, r.at)[0]]
            r.at += size
        return found

    for into in (out.fields, out.methods):
        for _ in range(r.take("H")):
            f, name, desc = r.take("HHH")
            into.append({"name": pool[name], "descriptor": pool[desc], "signature": attributes().get("Signature"), "access_flags": f})
    a = attributes()
    out.signature, out.source_file = a.get("Signature"), a.get("SourceFile")
    return out


_NOISE = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|""".*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_DECLARED = re.compile(r"((?:\b(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*)(?:@\s*)?\b(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)|([{}])")


def declared_types(text: str) -> list[tuple[str, bool]]:
    """(name with enclosing types, dotted; whether it and the type directly around it are public), in order."""
    text = _NOISE.sub(lambda m: " " if m.group().startswith("/") else '""', text or "")
    out, stack, pending = [], [], None
    for m in _DECLARED.finditer(text):
        if m[4] == "{":
            stack.append(pending)
            pending = None
        elif m[4] == "}":
            if stack:
                stack.pop()
        else:
            around = [s for s in stack if s]
            if len(around) < len(stack):
                continue  # local to a body
            name = ".".join([*[s[0] for s in around], m[3]])
            public = "public" in m[1].split()
            out.append((name, public and (not around or around[-1][1])))
            pending = (m[3], public)
    return out


def _numbered(name: str) -> bool:
    """Anonymous and local classes end in digits only."""
    return name.rsplit(".", 1)[-1].isdigit()


def _dotted(name: str) -> str:
    return name.replace("/", ".").replace("$", ".")


def _is_class(r: dict) -> bool:
    return r["ext"] == "class"


def parsed(r: dict):
    """What all indexes read of a file, made once: a ClassFile, or a source's package and types [(name, public)]."""
    if _is_class(r):
        return parse_class(r["content"])
    text = bytes(r["content"]).decode("utf-8", "replace")
    pkg = package_name(text)
    return pkg, [(f"{pkg}.{name}" if pkg else name, public) for name, public in declared_types(text)]


def short_names(r: dict, p):
    if _is_class(r):
        if p.flags & PUBLIC and not _numbered(_dotted(p.name)):
            yield _dotted(p.name).rsplit(".", 1)[-1], _dotted(p.name)
    else:
        for name, public in p[1]:
            if public:
                yield name.rsplit(".", 1)[-1], name


def full_names(r: dict, p):
    names = [_dotted(p.name)] if _is_class(r) else [n for n, _ in p[1]]
    return [(n, r["path"]) for n in names if not _numbered(n)]


def packages(r: dict, p):
    if _is_class(r):
        pkg, _, simple = p.name.rpartition("/")
        return [] if "$" in simple else [(pkg.replace("/", "."), {"simple_name": simple, "kind": "CLASS"})]
    return [(p[0], {"simple_name": r["name"].removesuffix(".java"), "kind": "SOURCE"})]


def supertypes(r: dict, p):
    return [(f"{s}#{p.name}", p.name) for s in [p.super_name, *p.interfaces] if s]


def stubs(r: dict, p):
    return [(p.name, p.stub())] if p.flags & PUBLIC else []


def _definition(name: str, version: int, fn, *exts: str) -> IndexDefinition:
    return IndexDefinition(name, version, python_extractor(fn, ["path", "name", "ext", "content"], parsed), F.col("ext").isin(*exts))


def definitions() -> list[IndexDefinition]:
    """The five indexes over files (file_id, path, name, ext, content), all from one parse. Made when a session exists."""
    both = ("java", "class")
    return [
        _definition("short_names", 2, short_names, *both),
        _definition("full_names", 2, full_names, *both),
        _definition("packages", 1, packages, *both),
        _definition("supertypes", 1, supertypes, "class"),
        _definition("stubs", 5, stubs, "class"),
    ]


def edges(entries):
    """(src, dst) of the supertype index, for graph.descendants."""
    e = entries.where("index_id = 'supertypes'")
    return e.select(F.substring_index("key", "#", 1).alias("src"), F.col("value").alias("dst")).distinct()


def stub_rows(entries):
    """The stub index with its values as a struct's columns, name with slashes."""
    return entries.where("index_id = 'stubs'").select("file_id", F.from_json("value", STUB).alias("s")).select("file_id", "s.*")


def parse_descriptor(descriptor: str) -> tuple[list[str], str]:
    """(parameter types, result type) of a method descriptor; of a field's, ([], type). Arrays end in []."""
    base = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}

    def one(at: int) -> tuple[str, int]:
        dims = 0
        while descriptor[at] == "[":
            dims, at = dims + 1, at + 1
        if descriptor[at] == "L":
            end = descriptor.index(";", at)
            return descriptor[at + 1 : end].replace("/", ".") + "[]" * dims, end + 1
        return base[descriptor[at]] + "[]" * dims, at + 1

    at, args = 0, []
    if descriptor[0] == "(":
        at = 1
        while descriptor[at] != ")":
            t, at = one(at)
            args.append(t)
        at += 1
    return args, one(at)[0]


@dataclass(frozen=True)
class Type:
    """A type of a signature: a class or base type by its dotted name, a type variable (variable), or a wildcard (bound: ? +
    or -); args are its type arguments, inner what follows a dot, dims how often it is an array."""

    name: str
    args: tuple = ()
    inner: Type | None = None
    dims: int = 0
    variable: bool = False
    bound: str = ""

    def __str__(self) -> str:
        if self.bound:
            return "?" if self.bound == "?" else f"? {'extends' if self.bound == '+' else 'super'} {self.args[0]}"
        args = f"<{', '.join(map(str, self.args))}>" if self.args else ""
        return f"{self.name}{args}{f'.{self.inner}' if self.inner else ''}{'[]' * self.dims}"


@dataclass(frozen=True)
class Signature:
    """A class's, method's or field's generic signature: type parameters (name, bounds), and the types of its parts."""

    variables: tuple = ()
    parameters: tuple = ()
    result: Type | None = None
    supers: tuple = ()
    throws: tuple = ()


_BASE = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def parse_signature(text: str, of_class: bool = False) -> Signature:
    """The type tree of a signature or descriptor (Java Virtual Machine Specification, 4.7.9.1). Raises ValueError where the
    text isn't one."""
    at = 0

    def peek() -> str:
        return text[at] if at < len(text) else ""

    def eat(c: str) -> None:
        nonlocal at
        if not text.startswith(c, at):
            raise ValueError(f"{c!r} expected at {at} of {text!r}")
        at += len(c)

    def word(stops: str) -> str:
        nonlocal at
        begin = at
        while at < len(text) and text[at] not in stops:
            at += 1
        if begin == at:
            raise ValueError(f"name expected at {at} of {text!r}")
        return text[begin:at]

    def arguments() -> tuple:
        if peek() != "<":
            return ()
        eat("<")
        out = []
        while peek() != ">":
            mark = peek()
            if mark == "*":
                eat("*")
                out.append(Type("?", bound="?"))
            elif mark and mark in "+-":
                eat(mark)
                out.append(Type("?", (one(),), bound=mark))
            else:
                out.append(one())
        eat(">")
        return tuple(out)

    def one() -> Type:
        nonlocal at
        dims = 0
        while peek() == "[":
            eat("[")
            dims += 1
        kind = peek()
        at += 1
        if kind == "T":
            name = word(";")
            eat(";")
            return Type(name, dims=dims, variable=True)
        if kind == "L":
            steps = [(word("<;.").replace("/", "."), arguments())]
            while peek() == ".":
                eat(".")
                steps.append((word("<;."), arguments()))
            eat(";")
            out = None
            for k, (name, args) in reversed(list(enumerate(steps))):
                out = Type(name, args, out, 0 if k else dims)
            return out
        if kind not in _BASE or not kind:
            raise ValueError(f"type expected at {at - 1} of {text!r}")
        return Type(_BASE[kind], dims=dims)

    def variables() -> tuple:
        if peek() != "<":
            return ()
        eat("<")
        out = []
        while peek() != ">":
            name, bounds = word(":"), []
            while peek() == ":":
                eat(":")
                if peek() not in (":", ">") and peek() in "LT[":  # a class bound may be left out
                    bounds.append(one())
            out.append((name, tuple(bounds)))
        eat(">")
        return tuple(out)

    def all_of(done: str = "") -> tuple:
        out = []
        while peek() and peek() != done:
            out.append(one())
        return tuple(out)

    names = variables()
    if of_class:
        return Signature(names, supers=all_of())
    if peek() == "(":
        eat("(")
        parameters = all_of(")")
        eat(")")
        result, throws = one(), []
        while peek() == "^":
            eat("^")
            throws.append(one())
        out = Signature(names, parameters, result, throws=tuple(throws))
    else:
        out = Signature(names, result=one())
    if at != len(text):
        raise ValueError(f"more than a signature: {text!r}")
    return out


def shown_types(signatures, of_class: bool = False):
    """Column of strings: a signature's parameters and result as in source, or a class's supertypes; null if it isn't one."""

    @F.pandas_udf("string")
    def show(texts):
        def one(text):
            if text is None:
                return None
            try:
                s = parse_signature(text, of_class)
            except ValueError:
                return None
            if of_class:
                return ", ".join(map(str, s.supers))
            return f"({', '.join(map(str, s.parameters))}) {s.result}" if text.lstrip("<").find("(") >= 0 else str(s.result)

        return texts.map(one, na_action=None)

    return show(signatures)


def dump(stub: dict) -> str:
    return json.dumps(stub, sort_keys=True)
