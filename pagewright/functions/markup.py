"""SQL expressions over markup: tags, attributes, character references, text, and references to urls.

They nest deeply, so they are put together as SQL text: one call to the JVM for a column, not hundreds."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint
from itertools import count

from .text import URL

Expr = str
_NUMBERS = count()

#: The rest of a tag behind its name; quoted values may hold any character. Possessive, so a long tag needs no stack.
REST = r'(?:[^\x27">]++|"[^"]*+"|\x27[^\x27]*+\x27)*+'
#: Any tag, declaration or processing instruction.
TAG = rf"<(?:/?[a-zA-Z]{REST}|[!?][^>]*+)>"
ATTRIBUTE = r'[^\s"\x27=<>/]+(?:\s*=\s*(?:"[^"]*"|\x27[^\x27]*\x27|[^\s"\x27>]*))?'
#: Character references: numbers, and the names of HTML 4 with their semicolon.
REFERENCE = r"&(?:#[0-9]{1,8};?|#[xX][0-9a-fA-F]{1,7};?|[a-zA-Z][a-zA-Z0-9]*;)"
NAMES = {name: chr(code) for name, code in sorted(name2codepoint.items())}
#: The names as a map; where many expressions need it, hand them a column that holds it.
NAMES_MAP = f"from_json(r'{json.dumps(NAMES)}', 'map<string,string>')"


def raw(value: str) -> Expr:
    """A literal that is taken as it stands; patterns write a quote as \\x27."""
    if "'" in value:
        raise ValueError(f"a quote in {value!r}")
    return f"r'{value}'"


def _lambda(body: Callable[..., Expr], n: int = 1) -> Expr:
    names = [f"v{next(_NUMBERS)}" for _ in range(n)]
    return f"{names[0] if n == 1 else '(' + ', '.join(names) + ')'} -> {body(*names)}"


def each(items: Expr, body: Callable[[Expr], Expr]) -> Expr:
    return f"transform({items}, {_lambda(body)})"


def numbered(items: Expr, body: Callable[[Expr, Expr], Expr]) -> Expr:
    return f"transform({items}, {_lambda(body, 2)})"


def only(items: Expr, test: Callable[[Expr], Expr]) -> Expr:
    return f"filter({items}, {_lambda(test)})"


def some(items: Expr, test: Callable[[Expr], Expr]) -> Expr:
    return f"exists({items}, {_lambda(test)})"


def let(value: Expr, body: Callable[[Expr], Expr]) -> Expr:
    """Evaluate value once and hand it to body."""
    return f"{each(f'array({value})', body)}[0]"


def struct(**fields: Expr) -> Expr:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def last(items: Expr) -> Expr:
    return let(items, lambda x: f"get({x}, size({x}) - 1)")


def opening(names: str) -> str:
    """The pattern of an opening tag of one of the names, which are given as alternatives."""
    return rf"(?is)<(?:{names})(?:[\s/]{REST})?>"


def closing(names: str) -> str:
    return rf"(?i)</(?:{names})(?:\s[^>]*)?>"


def region(names: str, comments: bool = False) -> str:
    """The pattern of an element of each name, and of comments, up to its first end, or to the end of the page without one."""
    ways = [r"!--.*?(?:-->|\z)"] if comments else []
    return "(?is)<(?:" + "|".join([*ways, *(rf"{n}(?:[\s/]{REST})?>.*?(?:</{n}(?:\s[^>]*)?>|\z)" for n in names.split("|"))]) + ")"


def every(x: Expr, pattern: str) -> Expr:
    return f"regexp_extract_all({x}, {raw(pattern)}, 0)"


def replaced(x: Expr, pattern: str, by: str = "") -> Expr:
    return f"regexp_replace({x}, {raw(pattern)}, {raw(by)})"


def found(x: Expr, pattern: str) -> Expr:
    return f"regexp_extract({x}, {raw(pattern)}, 1)"


def like(x: Expr, pattern: str) -> Expr:
    return f"({x} rlike {raw(pattern)})"


def fold(x: Expr) -> Expr:
    return f"trim({replaced(x, r'(?U)\s+', ' ')})"


def character(code: Expr) -> Expr:
    """The character of a code point; what is none is the replacement character."""
    known = lambda c: f"({c} between 1 and 55295 or {c} between 57344 and 1114111)"
    return let(code, lambda c: f"if({known(c)}, decode(unhex(lpad(hex({c}), 8, '0')), 'UTF-32'), '�')")


def referred(reference: Expr, names: Expr) -> Expr:
    """What a character reference stands for; itself if its name is not known."""
    number = character(f"cast({found(reference, '^&#([0-9]+)')} as bigint)")
    hexed = character(f"cast(conv({found(reference, '^&#[xX]([0-9a-fA-F]+)')}, 16, 10) as bigint)")
    named = f"{names}[{found(reference, '^&([a-zA-Z0-9]+);')}]"
    return f"case when {like(reference, '^&#[0-9]')} then {number} when {like(reference, '^&#')} then {hexed} else coalesce({named}, {reference}) end"


def unescape(x: Expr, names: Expr = NAMES_MAP) -> Expr:
    """A text with its character references replaced; null for null."""
    rejoined = lambda t: let(struct(a=f"split({t}, {raw(REFERENCE)}, -1)", r=every(t, REFERENCE)), lambda p: f"concat(array_join(zip_with(slice({p}.a, 1, size({p}.r)), {p}.r, (a, r) -> concat(a, {referred('r', names)})), ''), element_at({p}.a, -1))")
    return let(x, lambda t: f"if(contains({t}, '&'), {rejoined(t)}, {t})")


def attribute(tag: Expr, name: str, names: Expr = NAMES_MAP) -> Expr:
    """The value of a tag's first attribute of that name; empty if it has none, null if there is no such attribute."""
    own = f"get({only(every(tag, ATTRIBUTE), lambda a: like(a, rf'(?i)^{name}(?:[\s=]|\z)'))}, 0)"
    return unescape(replaced(found(own, r"(?s)^[^=]*=\s*(.*)"), r'(?s)^(["\x27])(.*)\1$', "$2"), names)


def _without_dots(path: Expr) -> Expr:
    """A path whose . and .. segments have been followed."""
    step = "(d, s) -> case s when '.' then d when '..' then slice(d, 1, greatest(size(d) - 1, 1)) else concat(d, array(s)) end"
    walked = lambda p: f"concat(array_join(aggregate(split({p}, '/'), cast(array() as array<string>), {step}), '/'), if({like(p, r'/\.\.?$')}, '/', ''))"
    return let(path, lambda p: f"if({like(p, r'(?:^|/)\.\.?(?:/|$)')}, {walked(p)}, {p})")


def url_parts(url: Expr) -> Expr:
    """scheme, netloc, path, query of a url, each with its mark where it has one: http:, //host, /path, ?query."""
    part = lambda u, i: f"regexp_extract({u}, {raw(URL)}, {i})"
    marked = lambda u, i, before, after="": let(part(u, i), lambda x: f"if({x} = '', '', concat('{before}', {x}, '{after}'))")
    return let(f"coalesce({url}, '')", lambda u: struct(whole=u, scheme=marked(u, 1, "", ":"), host=marked(u, 2, "//"), path=part(u, 3), query=marked(u, 4, "?")))


def resolved(base: Expr, reference: Expr) -> Expr:
    """A reference seen from a base, which is given as url_parts(); the empty reference is the base itself, null is null."""

    def seen(ref: Expr) -> Expr:
        behind, path = found(ref, r"(?s)^[^?#]*((?:\?[^#]*)?)"), found(ref, r"(?s)^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)")
        folder = let(found(f"{base}.path", "(?s)^(.*/)"), lambda f: f"if({f} = '' and {base}.host <> '', '/', {f})")
        inside = f"if({path} = '', {base}.path, {_without_dots(f'if(startswith({path}, {chr(39)}/{chr(39)}), {path}, concat({folder}, {path}))')})"
        query = f"if({path} = '' and {behind} = '', {base}.query, {behind})"
        return (
            f"case when {ref} = '' or {base}.whole = '' then concat({base}.whole, {ref}) when {like(ref, '^[^:/?#]+:')} then {ref} when startswith({ref}, '//') then concat({base}.scheme, {ref}) "
            f"else concat({base}.scheme, {base}.host, {inside}, {query}, {found(ref, '(?s)(#.*)$')}) end"
        )

    return let(replaced(reference, r"^[\x00-\x20]+|[\t\r\n]|[\x00-\x20]+$"), seen)
