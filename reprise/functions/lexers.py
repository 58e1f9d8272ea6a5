"""Lexers and fragment finders for source code.

A lexer is a table of patterns; a fragment finder walks the tokens with a stack of braces (or of indents
for Python) and names functions, methods, constructors, types and the whole file by the node types that
fragment queries use. It sees tokens, not a grammar: string literals are one token each, and where a
grammar has to tell an expression from a declaration it goes by the tokens in front of a brace.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass(slots=True)
class Token:
    type: str
    text: str
    start: int
    end: int


@dataclass(frozen=True)
class Language:
    """Patterns by token type, in order; keywords and operators are their own type."""

    name: str
    root: str
    patterns: tuple[tuple[str, str], ...]
    keywords: frozenset[str] = field(default=frozenset())
    type_names: bool = False  # whether names that begin with a capital letter are type_identifier

    def compiled(self) -> re.Pattern[str]:
        if self.name not in _compiled:
            _compiled[self.name] = re.compile("|".join(f"(?P<{t}>{p})" for t, p in self.patterns))
        return _compiled[self.name]


_compiled: dict[str, re.Pattern[str]] = {}

_C_COMMENT = (("line_comment", r"//[^\n]*"), ("block_comment", r"/\*[\s\S]*?(?:\*/|\Z)"))
_DOUBLE, _SINGLE = r'"(?:\\[\s\S]|[^"\\\n])*(?:"|(?=\n)|\Z)', r"'(?:\\[\s\S]|[^'\\\n])*(?:'|(?=\n)|\Z)"
_NAME = r"[^\W\d]\w*"
_OPERATOR = r">>>=|<<=|>>=|\.\.\.|\*\*=|//=|===|!==|\?\?=|&&=|\|\|=|::|->|=>|:=|<-|\+\+|--|&&|\|\||\?\?|\?\.|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[^\w\s]"
_HEX, _FLOAT, _INT = r"0[xX][0-9a-fA-F_]+[lLuUn]*", r"(?:\d[\d_]*\.(?!\.)[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlL]?|\d[\d_]*[eE][+-]?\d+[fFdD]?", r"\d[\d_]*[lLuUn]*"

JAVA = Language(
    "java", "program",
    (*_C_COMMENT, ("string_literal", rf'"""[\s\S]*?(?:"""|\Z)|{_DOUBLE}'), ("character_literal", _SINGLE), ("hex_integer_literal", _HEX),
     ("decimal_floating_point_literal", _FLOAT), ("decimal_integer_literal", _INT), ("identifier", rf"\$?{_NAME}[\w$]*|\$"), ("op", _OPERATOR)),
    frozenset(
        "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if "
        "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
        "synchronized this throw throws transient try void volatile while true false null".split()
    ),
    True,
)
C = Language(
    "c", "translation_unit",
    (*_C_COMMENT, ("preproc", r"#[^\n\\]*(?:\\[\s\S][^\n\\]*)*"), ("string_literal", rf"(?:L|u8|u|U)?{_DOUBLE}"), ("char_literal", rf"(?:L|u|U)?{_SINGLE}"), ("number_literal", rf"{_HEX}|{_FLOAT}|{_INT}"),
     ("identifier", _NAME), ("op", _OPERATOR)),
    frozenset(
        "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short "
        "signed sizeof static struct switch typedef union unsigned void volatile while".split()
    ),
)
CPP = Language(
    "cpp", "translation_unit", C.patterns,
    C.keywords | frozenset("bool catch class constexpr delete explicit export false final friend mutable namespace new noexcept nullptr operator override "
                           "private protected public static_cast template this throw true try typename using virtual".split()),
)
_JS = (
    *_C_COMMENT, ("template_string", r"`(?:\\[\s\S]|[^`\\])*(?:`|\Z)"), ("string", rf"{_DOUBLE}|{_SINGLE}"), ("number", rf"{_HEX}|{_FLOAT}|{_INT}"),
    ("identifier", r"[^\W\d][\w$]*|\$[\w$]*"), ("op", _OPERATOR),
)
JAVASCRIPT = Language(
    "js", "program", _JS,
    frozenset(
        "async await break case catch class const continue debugger default delete do else export extends false finally for from function get if import in "
        "instanceof let new null of return set static super switch this throw true try typeof undefined var void while with yield".split()
    ),
)
TYPESCRIPT = Language("ts", "program", _JS, JAVASCRIPT.keywords | frozenset("abstract as declare enum implements interface namespace private protected public readonly type".split()))
TSX = Language("tsx", "program", _JS, TYPESCRIPT.keywords)
PYTHON = Language(
    "py", "module",
    (("comment", r"#[^\n]*"), ("string", rf'[rRbBuUfF]{{0,2}}(?:"""(?:\\[\s\S]|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\[\s\S]|[^\\])*?(?:\'\'\'|\Z)|{_DOUBLE}|{_SINGLE})'),
     ("float", _FLOAT), ("integer", rf"{_HEX}|0[oObB][\d_]+|{_INT}"), ("identifier", _NAME), ("line_join", r"\\\n"), ("op", _OPERATOR)),
    frozenset(
        "and as assert async await break case class continue def del elif else except finally for from global if import in is lambda match nonlocal not or "
        "pass raise return try while with yield True False None".split()
    ),
)
GO = Language(
    "go", "source_file",
    (*_C_COMMENT, ("raw_string_literal", r"`[^`]*(?:`|\Z)"), ("interpreted_string_literal", _DOUBLE), ("rune_literal", _SINGLE), ("float_literal", _FLOAT),
     ("int_literal", rf"{_HEX}|{_INT}"), ("identifier", _NAME), ("op", _OPERATOR)),
    frozenset(
        "break case chan const continue default defer else fallthrough false for func go goto if import interface map nil package range return select struct "
        "switch true type var".split()
    ),
)
RUST = Language(
    "rs", "source_file",
    (*_C_COMMENT, ("raw_string_literal", r'b?r#*"[\s\S]*?"#*'), ("string_literal", r'b?"(?:\\[\s\S]|[^"\\])*(?:"|\Z)'), ("char_literal", r"b?'(?:\\[^']+|[^'\\\n])'"),
     ("lifetime", r"'[^\W\d]\w*"), ("float_literal", r"\d[\d_]*\.(?![.\w])[\d_]*|\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?(?:f32|f64)?"), ("integer_literal", rf"{_HEX}|\d\w*"),
     ("identifier", _NAME), ("op", _OPERATOR)),
    frozenset(
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct "
        "super trait true type unsafe use where while".split()
    ),
    True,
)

LANGUAGES = {"java": JAVA, "c": C, "cpp": CPP, "js": JAVASCRIPT, "ts": TYPESCRIPT, "tsx": TSX, "py": PYTHON, "go": GO, "rs": RUST}
_COMMENTS = ("comment", "line_comment", "block_comment", "line_join")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def language(name: str) -> Language:
    """The lexer for a file extension; Java for unknown ones."""
    return LANGUAGES.get(name, JAVA)


def tokenize(text: str, lang: Language, comments: bool = False) -> list[Token]:
    out = []
    for m in lang.compiled().finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind in _COMMENTS:
            if comments and kind != "line_join":
                out.append(Token(kind, value, m.start(), m.end()))
            continue
        if kind == "op" or value in lang.keywords:
            kind = value
        elif kind == "identifier" and lang.type_names and value[:1].isupper():
            kind = "type_identifier"
        out.append(Token(kind, value, m.start(), m.end()))
    return out


def _partners(tokens: list[Token]) -> dict[int, int]:
    """Index of each bracket's partner; unclosed ones end with the last token."""
    stack, out = [], {}
    for i, t in enumerate(tokens):
        if t.type in _OPEN:
            stack.append(i)
        elif t.type in _CLOSE:
            while stack and tokens[stack[-1]].type != _CLOSE[t.type]:
                out[stack.pop()] = i - 1
            if stack:
                j = stack.pop()
                out[j], out[i] = i, j
    for j in stack:
        out[j] = len(tokens) - 1
    return out


#: Node types of statements by their first word, by language. The names of the grammars' nodes.
_STATEMENTS = {
    "java": {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "try": "try_statement", "switch": "switch_expression", "synchronized": "synchronized_statement"},
    "c": {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement"},
    "cpp": {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "try": "try_statement"},
    "js": {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "try": "try_statement", "switch": "switch_statement"},
    "go": {"if": "if_statement", "for": "for_statement"},
    "rs": {"if": "if_expression", "for": "for_expression", "while": "while_expression", "loop": "loop_expression", "match": "match_expression"},
    "py": {"if": "if_statement", "for": "for_statement", "while": "while_statement", "try": "try_statement", "with": "with_statement"},
}
_STATEMENTS |= {"ts": _STATEMENTS["js"], "tsx": _STATEMENTS["js"]}
_BLOCK = {"c": "compound_statement", "cpp": "compound_statement", "js": "statement_block", "ts": "statement_block", "tsx": "statement_block"}
_LAMBDA = {"java": ("->", "lambda_expression"), "js": ("=>", "arrow_function"), "ts": ("=>", "arrow_function"), "tsx": ("=>", "arrow_function")}
_MORE = {"if": ("else",), "try": ("catch", "finally"), "do": ("while",)}
_DECLARATIONS = {
    "java": "class_declaration interface_declaration enum_declaration method_declaration constructor_declaration",
    "c": "struct_specifier class_specifier enum_specifier union_specifier function_definition",
    "js": "class_declaration interface_declaration enum_declaration method_definition function_declaration generator_function_declaration",
    "go": "function_declaration method_declaration",
    "rs": "struct_item enum_item impl_item trait_item mod_item function_item",
    "py": "function_definition class_definition",
}
_DECLARATIONS |= {"cpp": _DECLARATIONS["c"], "ts": _DECLARATIONS["js"], "tsx": _DECLARATIONS["js"]}


def node_types(lang: Language) -> frozenset[str]:
    """The inner nodes that are told apart in a language."""
    more = [lang.root, _BLOCK.get(lang.name, "block"), *([_LAMBDA[lang.name][1]] if lang.name in _LAMBDA else [])]
    return frozenset([*_DECLARATIONS[lang.name].split(), *_STATEMENTS[lang.name].values(), *more])


def _end_of_statement(tokens: list[Token], i: int, lang: Language, partner: dict[int, int]) -> int:
    """The last token of the statement that begins at i."""
    last = len(tokens) - 1
    word = tokens[i].type
    if word == "{":
        return partner.get(i, last)
    if word not in _STATEMENTS[lang.name]:
        while i < last and tokens[i].type != ";":
            if tokens[i].type == "}":
                return i - 1
            i = partner.get(i, i) + 1 if tokens[i].type in _OPEN else i + 1
        return min(i, last)
    i += 1
    if lang.name in ("go", "rs"):  # a head without parentheses, up to its block
        while i < last and tokens[i].type != "{":
            i = partner.get(i, i) + 1 if tokens[i].type in ("(", "[") else i + 1
    elif i <= last and tokens[i].type in ("(", "await") and word not in ("do", "else"):
        i += tokens[i].type == "await"
        i = partner.get(i, i) + 1
    end = _end_of_statement(tokens, min(i, last), lang, partner)
    while end < last and tokens[end + 1].type in _MORE.get(word, ()):
        i = end + 2
        if i <= last and tokens[i].type == "(":
            i = partner.get(i, i) + 1
            if word == "do":
                return min(i, last)
        end = _end_of_statement(tokens, min(i, last), lang, partner)
    return end


def _inner(tokens: list[Token], lang: Language) -> list[tuple[str, int, int]]:
    """Statements, blocks and lambdas of languages with braces."""
    partner, out = _partners(tokens), []
    words, block = _STATEMENTS[lang.name], _BLOCK.get(lang.name, "block")
    arrow, kind = _LAMBDA.get(lang.name, (None, None))
    for i, t in enumerate(tokens):
        if t.type in words:
            before = tokens[i - 1].type if i else ""
            if (t.type == "while" and before == "}" and _closes_do(tokens, i, partner)) or before in (".", "->", "::") or (t.type == "for" and lang.name == "rs" and before in ("identifier", "type_identifier", ">")):
                continue
            out.append((words[t.type], i, _end_of_statement(tokens, i, lang, partner)))
        elif t.type == "{" and i in partner:
            before = tokens[i - 1].type if i else ""
            if before in (")", "else", "do", "try", "finally", "{", "}", ";", "->", "=>", "loop", "unsafe") or lang.name in ("go", "rs"):
                out.append((block, i, partner[i]))
        elif arrow and t.type == arrow and 0 < i < len(tokens) - 1:
            start = partner.get(i - 1, i - 1) if tokens[i - 1].type == ")" else i - 1
            if tokens[i + 1].type == "{":
                end = partner.get(i + 1, len(tokens) - 1)
            else:
                end = i + 1
                while end + 1 < len(tokens) and tokens[end + 1].type not in (",", ";", ")", "]", "}"):
                    end = partner.get(end + 1, end + 1) if tokens[end + 1].type in _OPEN else end + 1
            if lang.name != "java" or tokens[i - 1].type in (")", "identifier"):
                out.append((kind, start, end))
    return out


def _closes_do(tokens: list[Token], i: int, partner: dict[int, int]) -> bool:
    opened = partner.get(i - 1)
    return opened is not None and opened > 0 and tokens[opened - 1].type == "do"


def _python(text: str, tokens: list[Token]) -> list[tuple[str, int, int]]:
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    depth, first, firsts = 0, True, []  # tokens that begin a statement's line, with their column
    row_before = -1
    for i, t in enumerate(tokens):
        row = bisect_right(lines, t.start) - 1
        first = row != row_before and depth == 0
        if first:
            firsts.append((i, t.start - lines[row]))
        row_before = bisect_right(lines, max(t.start, t.end - 1)) - 1
        depth += (t.type in _OPEN) - (t.type in _CLOSE)
        depth = max(0, depth)
    out = []
    for n, (i, column) in enumerate(firsts):
        at = i + 1 if tokens[i].type == "async" and i + 1 < len(tokens) else i
        word = tokens[at].type
        kind = {"def": "function_definition", "class": "class_definition", **_STATEMENTS["py"]}.get(word)
        if kind:
            more = ("elif", "else") if word == "if" else ("else",) if word in ("for", "while") else ("except", "else", "finally") if word == "try" else ()
            end = next((j for j, c in firsts[n + 1 :] if c < column or (c == column and tokens[j].type not in more)), len(tokens))
            out.append((kind, i, end - 1))
            head = next((j for j, c in firsts[n + 1 :] if c <= column), len(tokens))
            inside = next((j for j, c in firsts[n + 1 :] if j < head and c > column), None)
            if inside is not None:
                out.append(("block", inside, head - 1))
    return out


def _member_start(tokens: list[Token], i: int, partner: dict[int, int]) -> int:
    """The first token of the declaration that token i is in: behind the last ; { } or, in C, a # line."""
    while i > 0:
        t = tokens[i - 1].type
        if t in (";", "{", "}", "preproc") or (t == ":" and i > 1 and tokens[i - 2].type in ("public", "private", "protected")):
            break
        i = partner.get(i - 1, i - 1) if t in _CLOSE else i - 1
    return i


def _braced(tokens: list[Token], lang: Language) -> list[tuple[str, int, int]]:
    partner, out = _partners(tokens), []
    types = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration"}
    if lang.name in ("c", "cpp"):
        types = {"struct": "struct_specifier", "class": "class_specifier", "enum": "enum_specifier", "union": "union_specifier"}
    if lang.name == "go":
        types = {}
    if lang.name == "rs":
        types = {"struct": "struct_item", "enum": "enum_item", "impl": "impl_item", "trait": "trait_item", "mod": "mod_item"}
    context = ["type"]  # of each open brace: type (members may follow) or block
    closes: list[int] = []
    names = [""]  # of the types around
    for i, t in enumerate(tokens):
        if closes and i == closes[-1]:
            closes.pop()
            context.pop()
            names.pop()
            continue
        if lang.name == "go" and t.type == "func":
            name = i + 1
            method = name < len(tokens) and tokens[name].type == "(" and partner.get(name, name) + 1 < len(tokens) and tokens[partner[name] + 1].type == "identifier"
            if len(context) == 1 and (method or (name < len(tokens) and tokens[name].type == "identifier")):
                j = _body(tokens, name, partner)
                out.append(("method_declaration" if method else "function_declaration", i, partner[j] if j is not None else _line_end(tokens, i)))
        elif lang.name == "rs" and t.type == "fn" and i + 1 < len(tokens) and tokens[i + 1].type == "identifier":
            j = _body(tokens, i, partner)
            start = i
            while start and (tokens[start - 1].type in ("pub", "async", "const", "unsafe", "extern") or (tokens[start - 1].type == ")" and tokens[partner.get(start - 1, 1) - 1].type == "pub")):
                start = partner[start - 1] if tokens[start - 1].type == ")" else start - 1
            if j is not None:
                out.append(("function_item", start, partner[j]))
        elif lang.name in ("js", "ts", "tsx") and t.type == "function":
            star = i + 1 < len(tokens) and tokens[i + 1].type == "*"
            name = i + 1 + star
            if name < len(tokens) and tokens[name].type == "identifier" and (i == 0 or tokens[i - 1].type in (";", "{", "}", ")", "export", "default", "async")):
                j = _body(tokens, name, partner)
                if j is not None:
                    start = i - 1 if i and tokens[i - 1].type == "async" else i
                    out.append(("generator_function_declaration" if star else "function_declaration", start, partner[j]))
        if t.type == ";" and context[-1] == "type" and lang.name == "java":
            start = _member_start(tokens, i, partner)
            name = _call(tokens, start, i, partner)
            if name is not None and len(context) > 1 and tokens[start].type != "," and _typed(tokens, start, name, partner):
                out.append(("method_declaration", start, i))
        if t.type != "{" or i not in partner:
            continue
        start = _member_start(tokens, i, partner)
        head, flat, k = [tokens[k].type for k in range(start, i)], [], start
        while k < i:  # the head without what is in parentheses
            flat.append(tokens[k].type)
            k = partner[k] + 1 if tokens[k].type == "(" and k in partner else k + 1
        word = next((h for h in flat if h in types), None)
        kind = "block"
        if lang.name == "rs":
            word = word or ("extern" if "extern" in head and "fn" not in head else None)
            if word and "fn" not in head:
                kind = "type"
                if word in types:
                    out.append((types[word], start, partner[i]))
        elif lang.name == "go":
            pass
        elif lang.name in ("c", "cpp"):
            name = _call(tokens, start, i, partner)
            if context[-1] == "type" and name is not None and "=" not in head[: max(0, name - start)]:
                out.append(("function_definition", start, partner[i]))
            elif word or "namespace" in head or head[:1] == ["extern"]:
                kind = "type"
                if word:
                    out.append((types[word], start, partner[i]))
        else:
            name = _call(tokens, start, i, partner)
            if word:
                kind = "type"
                out.append((types[word], start, partner[i]))
            elif "new" in head and head[-1:] == [")"] and "->" not in head[-3:]:
                kind = "type"  # an anonymous class
            elif context[-1] == "type" and (len(context) > 1 or lang.name == "java") and name is not None and "=" not in flat:
                if lang.name == "java":
                    if _typed(tokens, start, name, partner):
                        out.append(("method_declaration", start, partner[i]))
                    elif tokens[name].text == names[-1]:
                        out.append(("constructor_declaration", start, partner[i]))
                    else:
                        kind = "type"  # the body of an enum's constant
                else:
                    out.append(("method_definition", start, partner[i]))
            elif "@" in head and "interface" in head:
                kind = "type"
        context.append(kind)
        closes.append(partner[i])
        at = next((k for k in range(start, i) if tokens[k].type == word), None) if word else None
        names.append(tokens[at + 1].text if at is not None and at + 1 < i else "")
    return out


_PRIMITIVE = frozenset("int long short byte char boolean float double void".split())


def _after_modifiers(tokens: list[Token], start: int, name: int, partner: dict[int, int]) -> list[str]:
    """Types of the tokens between a declaration's modifiers, annotations and type parameters and its name."""
    i = start
    while i < name:
        t = tokens[i].type
        if t == "@":
            i += 2
            while i < name and tokens[i].type == ".":
                i += 2
            if i < name and tokens[i].type == "(":
                i = partner.get(i, i) + 1
        elif t in ("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "strictfp", "default"):
            i += 1
        elif t == "<":
            depth, i = 1, i + 1
            while i < name and depth:
                depth += (tokens[i].text.count("<")) - (tokens[i].text.count(">"))
                i += 1
        else:
            break
    return [tokens[k].type for k in range(i, name)]


def _typed(tokens: list[Token], start: int, name: int, partner: dict[int, int]) -> bool:
    """Whether a declaration has a return type in front of its name."""
    return any(h in ("identifier", "type_identifier", ">", "]") or h in _PRIMITIVE for h in _after_modifiers(tokens, start, name, partner))


def _call(tokens: list[Token], start: int, end: int, partner: dict[int, int]) -> int | None:
    """Index of the name in front of the first parenthesis of a declaration that is not an annotation's."""
    i = start
    while i < end:
        t = tokens[i].type
        if t == "@":
            i += 2
            while i < end and tokens[i].type == ".":
                i += 2
            if i < end and tokens[i].type == "(":
                i = partner.get(i, i) + 1
            continue
        if t == "(":
            return i - 1 if i > start and tokens[i - 1].type in ("identifier", "type_identifier", "get", "set", "of", "from") else None
        if t in ("=", "->", "=>"):
            return None
        i += 1
    return None


def _body(tokens: list[Token], i: int, partner: dict[int, int]) -> int | None:
    """The brace that opens the body of the function whose head begins at i."""
    while i < len(tokens):
        t = tokens[i].type
        if t == "{":
            if i and tokens[i - 1].type in ("interface", "struct") and i in partner:
                i = partner[i] + 1
                continue
            return i if i in partner else None
        if t == ";" or (t == "}"):
            return None
        i = partner.get(i, i) + 1 if t in ("(", "[") else i + 1
    return None


def _line_end(tokens: list[Token], i: int) -> int:
    while i + 1 < len(tokens) and tokens[i + 1].type not in ("func", "type", "var", "const", "import"):
        i += 1
    return i


def fragments(text: str, lang: Language, types: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(node type, first token, last token) of the nodes whose type is asked for, in order of their start."""
    tokens = tokenize(text, lang)
    return found(text, tokens, lang, types)


def found(text: str, tokens: list[Token], lang: Language, types: tuple[str, ...]) -> list[tuple[str, int, int]]:
    if not tokens:
        return []
    every = _python(text, tokens) if lang.name == "py" else [*_braced(tokens, lang), *_inner(tokens, lang)]
    every.append((lang.root, 0, len(tokens) - 1))
    return sorted({x for x in every if x[0] in types}, key=lambda x: (x[1], -x[2], x[0]))


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def position(starts: list[int], offset: int) -> tuple[int, int]:
    """(line, character) of an offset, from 0."""
    line = bisect_right(starts, offset) - 1
    return line, offset - starts[line]
