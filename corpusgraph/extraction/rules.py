"""Lexical extraction rules as plain data: what a definition, import, call and block looks like.

Rules run on masked lines (comments and string bodies blanked), except where a rule says it reads
the raw line. Add a rule by passing a longer list to the extraction functions.
"""

from __future__ import annotations

from typing import NamedTuple


class SymbolRule(NamedTuple):
    """A line of ``language`` matching ``regex`` defines group 1 with this ``kind``."""

    language: str
    kind: str
    regex: str
    raw: bool = False


class ImportRule(NamedTuple):
    """A line matching ``regex`` imports group 1. ``block`` limits it to lines inside ``keyword (``."""

    language: str
    regex: str
    block: str = ""


BRACES = ("go", "javascript", "typescript", "rust", "java", "scala", "apex", "kotlin", "c", "cpp", "csharp",
          "swift", "php", "bash", "hcl", "protobuf", "dart")
# A statement of these languages ends with its line unless a parenthesis is open.
LINE_ENDED = ("go", "kotlin", "swift", "scala", "hcl", "protobuf", "bash", "lua")
NO_IMPORTS = ("csharp", "swift", "php", "lua", "bash", "yaml", "hcl")
CALLS = ("go", "javascript", "typescript", "rust", "c", "cpp", "python", "java", "scala", "apex", "kotlin", "ruby",
         "elixir", "dart")

_DQ = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SQ = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_CHAR = r"'(?:\\[^\n']+|[^'\\\n])'"
_TRIPLE = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"
_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_HASH = r"#[^\n]*"

# Comments and strings per language, earlier alternatives win at the same place.
MASKED = {
    "go": f"{_C_COMMENT}|{_DQ}|`[^`]*`|{_CHAR}",
    "javascript": f"{_C_COMMENT}|{_DQ}|{_SQ}|`[^`]*`",
    "typescript": f"{_C_COMMENT}|{_DQ}|{_SQ}|`[^`]*`",
    "python": f"{_TRIPLE}|{_HASH}|{_DQ}|{_SQ}",
    "ruby": f"(?m:^=begin[\\s\\S]*?^=end)|{_HASH}|{_DQ}|{_SQ}",
    "elixir": f"{_TRIPLE}|{_HASH}|{_DQ}",
    "bash": f"(?<![$\\w]){_HASH}|{_DQ}|{_SQ}",
    "yaml": f"{_HASH}|{_DQ}|{_SQ}",
    "hcl": f"{_HASH}|{_C_COMMENT}|{_DQ}",
    "php": f"{_HASH}|{_C_COMMENT}|{_DQ}|{_SQ}",
    "lua": rf"--\[\[[\s\S]*?\]\]|--[^\n]*|{_DQ}|{_SQ}",
    "dart": f"{_TRIPLE}|{_C_COMMENT}|{_DQ}|{_SQ}",
    "kotlin": f"{_TRIPLE}|{_C_COMMENT}|{_DQ}|{_CHAR}",
    "scala": f"{_TRIPLE}|{_C_COMMENT}|{_DQ}|{_CHAR}",
    "swift": f"{_TRIPLE}|{_C_COMMENT}|{_DQ}",
    "java": f"{_TRIPLE}|{_C_COMMENT}|{_DQ}|{_CHAR}",
    "apex": f"{_C_COMMENT}|{_SQ}",
    "protobuf": f"{_C_COMMENT}|{_DQ}|{_SQ}",
    "rust": f"{_C_COMMENT}|{_DQ}|{_CHAR}",
    "c": f"{_C_COMMENT}|{_DQ}|{_CHAR}",
    "cpp": f"{_C_COMMENT}|{_DQ}|{_CHAR}",
    "csharp": f"{_C_COMMENT}|{_DQ}|{_CHAR}",
}

# Words that open (+), close (-) or end (;) a block, for languages without braces.
_RUBY_OPEN = r"^\s*(?:while|until|for)\b.*\bdo\b|(?:^\s*|=\s*)(?:def|class|module|if|unless|case|while|until|for|begin)\b|\bdo\b"
BLOCK_EVENTS = {
    "ruby": (rf"{_RUBY_OPEN}|\bend\b", r"\bend$"),
    "elixir": (r"\bdo:|\bdo\b|\bfn\b|\bend\b", r"\bend$"),
    "lua": (r"\b(?:function|if|do|repeat)\b|\b(?:end|until)\b", r"(?:end|until)$"),
}

_JMOD = (r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|sealed|global|virtual|override|"
         r"synchronized|default|native|transient|volatile|with sharing|without sharing|partial|async|readonly|implicit|lazy|case|open|"
         r"data|inner|value|inline|suspend|operator|infix|tailrec|annotation|companion|lateinit|external|actual|expect|const|vararg|"
         r"enum(?=\s+class)|mutating|fileprivate|new|unsafe|extern)\s+)*")
_NOT_STATEMENT = r"(?!\s*(?:if|for|while|switch|catch|return|else|do|try|new|throw|function|await|yield|delete|typeof|case|using|lock|goto|sizeof|assert)\b)"
_EXPORT = r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_PUB = r"^\s*(?:pub(?:\([^)]*\))?\s+)?"


def _rules(language: str, *pairs: tuple[str, str], raw: bool = False) -> list[SymbolRule]:
    return [SymbolRule(language, kind, regex, raw) for kind, regex in pairs]


_JS = [
    ("function", _EXPORT + r"(?:async\s+)?function\s*\*?\s*([\w$]+)"),
    ("class", _EXPORT + r"(?:abstract\s+)?class\s+([\w$]+)"),
    ("interface", _EXPORT + r"interface\s+([\w$]+)"),
    ("type", _EXPORT + r"type\s+([\w$]+)\s*(?:<[^=]*>\s*)?="),
    ("enum", _EXPORT + r"(?:const\s+)?enum\s+([\w$]+)"),
    ("function", _EXPORT + r"(?:const|let)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::\s*[^=]+)?=>|[\w$]+\s*=>)"),
    ("method", r"^\s+" + _NOT_STATEMENT + r"(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?#?([A-Za-z_$][\w$]*)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[^{]+)?\{"),
]
_JAVA = [
    ("class", rf"^\s*{_JMOD}(?:class|record)\s+(\w+)"),
    ("interface", rf"^\s*{_JMOD}@?interface\s+(\w+)"),
    ("enum", rf"^\s*{_JMOD}enum\s+(\w+)"),
    ("constructor", rf"^\s*{_NOT_STATEMENT}{_JMOD}([A-Z]\w*)\s*\([^()]*\)\s*(?:throws [\w., ]+)?\s*\{{"),
    ("method", rf"^\s*{_NOT_STATEMENT}{_JMOD}(?:<[^>]+>\s+)?(?!(?:public|private|protected|static|final|abstract)\b)[A-Za-z_][\w.]*(?:<[^()=]*>)?(?:\[\])*\s+(\w+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)?\s*(?:throws [\w., ]+)?\s*(?:[{{;]|$)"),
    ("field", rf"^\s*{_NOT_STATEMENT}(?!import|package){_JMOD}[A-Za-z_][\w.]*(?:<[^()=]*>)?(?:\[\])*\s+(\w+)\s*(?:=|;)"),
]

SYMBOL_RULES: list[SymbolRule] = [
    *_rules(
        "go",
        ("method", r"^func\s*\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"),
        ("struct", r"^\s*type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^\s*type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"),
        ("type", r"^\s*type\s+(\w+)"), ("constant", r"^\s*const\s+(\w+)"), ("variable", r"^\s*var\s+(\w+)"),
    ),
    *_rules("python", ("function", r"^\s*(?:async\s+)?def\s+(__init__|[A-Za-z]\w*)"), ("class", r"^\s*class\s+(\w+)")),
    *_rules("javascript", *_JS), *_rules("typescript", *_JS),
    *_rules(
        "rust",
        ("function", _PUB + r"(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn\s+(\w+)(?![^{]*;\s*$)"),
        ("struct", _PUB + r"struct\s+(\w+)"), ("enum", _PUB + r"enum\s+(\w+)"),
        ("trait", _PUB + r"(?:unsafe\s+)?trait\s+(\w+)"),
        ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[^{]*\sfor\s+)?([\w:]+(?:<[^>{]*>)?)"),
        ("type", _PUB + r"type\s+(\w+)"), ("constant", _PUB + r"const\s+(\w+)\s*:"),
        ("variable", _PUB + r"static\s+(?:mut\s+)?(\w+)"), ("module", _PUB + r"mod\s+(\w+)"),
    ),
    *_rules("java", *_JAVA), *_rules("apex", *_JAVA),
    *_rules(
        "scala",
        ("class", rf"^\s*{_JMOD}class\s+(\w+)"), ("trait", rf"^\s*{_JMOD}trait\s+(\w+)"),
        ("object", rf"^\s*{_JMOD}object\s+(\w+)"), ("method", rf"^\s*{_JMOD}def\s+(\w+)"),
    ),
    *_rules(
        "kotlin",
        ("enum", rf"^\s*{_JMOD}(?<=enum\s)class\s+(\w+)"), ("interface", rf"^\s*{_JMOD}(?:fun\s+)?interface\s+(\w+)"),
        ("class", rf"^\s*{_JMOD}class\s+(\w+)"), ("object", rf"^\s*{_JMOD}object\s+(\w+)"),
        ("function", rf"^\s*{_JMOD}fun\s+(?:<[^>]*>\s+)?(?:[\w<>?, ]+\.)?(\w+)"),
        ("type", rf"^\s*{_JMOD}typealias\s+(\w+)"),
        ("constant", rf"^\s*(?:\w+\s+)*const\s+val\s+(\w+)"), ("variable", rf"^\s*{_JMOD}va[lr]\s+(\w+)"),
    ),
    *_rules(
        "ruby",
        ("method", r"^\s*def\s+(?:self\.)?([\w?!=]+)"), ("class", r"^\s*class\s+([A-Z][\w:]*)"), ("module", r"^\s*module\s+([\w:]+)"),
    ),
    *[
        rule
        for lang in ("c", "cpp")
        for rule in _rules(
            lang,
            ("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)[^;()]*(?:\{|$)"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)[^;()]*(?:\{|$)"),
            ("type", r"^\s*typedef\s+[^;{]*?(\w+)\s*;"),
            ("function", r"^\s*" + _NOT_STATEMENT + r"(?!#|typedef|struct\s+\w+\s*\{)[A-Za-z_][\w:<>,\s*&]*?[\s*&]\**(~?[\w:]+)\s*\([^;]*\)?\s*(?:const\s*)?(?:noexcept\s*)?(?:\{.*)?$"),
        )
    ],
    *_rules(
        "elixir",
        ("module", r"^\s*defmodule\s+([\w.]+)"), ("macro", r"^\s*defmacrop?\s+(\w+[?!]?)"),
        ("interface", r"^\s*defprotocol\s+([\w.]+)"), ("function", r"^\s*defp?\s+(\w+[?!]?)"),
    ),
    *_rules(
        "hcl",
        ("resource", r"^\s*resource\s+(\"[^\"]*\"(?:\s+\"[^\"]*\")*)\s*\{"),
        ("module", r"^\s*(?:module|provider)\s+(\"[^\"]*\"(?:\s+\"[^\"]*\")*)\s*\{"),
        ("variable", r"^\s*(?:variable|output|data)\s+(\"[^\"]*\"(?:\s+\"[^\"]*\")*)\s*\{"),
        ("module", r"^\s*(terraform)\s*\{"), ("variable", r"^\s*(locals)\s*\{"), raw=True,
    ),
    *_rules(
        "protobuf",
        ("struct", r"^\s*message\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("interface", r"^\s*service\s+(\w+)"),
        ("method", r"^\s*rpc\s+(\w+)"),
    ),
    *_rules(
        "dart",
        ("class", r"^\s*(?:(?:abstract|base|final|sealed|interface|mixin)\s+)*class\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"),
        ("mixin", r"^\s*(?:base\s+)?mixin\s+(\w+)"), ("extension", r"^\s*extension\s+(?!on\b)(\w+)"), ("type", r"^\s*typedef\s+(\w+)\s*(?:<[^=]*>)?\s*="),
        ("getter", r"^\s*(?:(?:static|external|[\w<>?,]+)\s+)*get\s+(\w+)"), ("setter", r"^\s*(?:(?:static|external|void)\s+)*set\s+(\w+)\s*\("),
        ("constructor", r"^\s*(?:const\s+|factory\s+)+([A-Z]\w*)(?:\.\w+)?\s*\("), ("constructor", r"^\s+([A-Z]\w*)(?:\.\w+)?\s*\([^)]*\)\s*(?::[^{;]*)?[;{]"),
        ("function", r"^\s*" + _NOT_STATEMENT + r"(?:(?:static|external|async)\s+)*[A-Za-z_][\w<>?,. ]*\s+(\w+)\s*\([^;]*\)\s*(?:async\*?\s*)?(?:\{|=>|;)"),
    ),
    *_rules(
        "csharp",
        ("class", rf"^\s*{_JMOD}class\s+(\w+)"),
        ("method", rf"^\s*{_NOT_STATEMENT}{_JMOD}[A-Za-z_][\w.]*(?:<[^()=]*>)?(?:\[\])*\s+(\w+)\s*(?:<\w+>)?\([^;]*\)\s*(?:\{{|=>|$|;)"),
    ),
    *_rules("swift", ("class", rf"^\s*{_JMOD}(?:class|struct|enum|extension|actor)\s+(?!func\b|var\b)(\w+)"), ("function", rf"^\s*{_JMOD}(?:class\s+)?func\s+(\w+)")),
    *_rules("php", ("class", rf"^\s*{_JMOD}class\s+(\w+)"), ("method", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)+function\s+&?(\w+)"), ("function", r"^\s*function\s+&?(\w+)")),
    *_rules("lua", ("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)")),
    *_rules("bash", ("function", r"^\s*(?:function\s+)([\w:-]+)"), ("function", r"^\s*([\w:-]+)\s*\(\)\s*\{?")),
]

# Languages whose lines may hold several statements, and what cuts them: a bracket or semicolon with a word behind it.
MANY_STATEMENTS = tuple(lang for lang in BRACES if lang != "hcl")
_HEAD = r"(?=\s*[\w@~#*\[<&])"
NEXT_STATEMENT = r"[{};]" + _HEAD
STATEMENT_CUT = r"(?<=[{};])" + _HEAD
# Parts that the head of a statement may extend over (braces and semicolons inside of its parentheses cut as well).
STATEMENT_PARTS = 8
# Lines of a chunk (as a power of two), and bits of a place within a line; LINE_END lies behind all of them.
CHUNK_SHIFT = 14
AT_BITS = 28
LINE_END = (1 << AT_BITS) - 1

CALLABLES = ("function", "method", "constructor", "getter", "setter")
TYPE_LIKE = ("struct", "class", "interface", "trait", "object", "enum", "mixin", "extension")
_NESTED = r"(?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*"
# Behind a name: type parameters, then the list.
BEFORE_PARAMETERS = r"\s*(?:<[^(]*>|\[[^\]]*\])?\s*"
PARAMETERS = rf"\({_NESTED}\)"

# Lines inside a Go ``const (`` or ``var (`` group define names as well.
GO_GROUP_NAME = r"^\s+(\w+)\b(?!\s*[.(\[])"

GO_TYPE_GROUP = _rules(
    "go",
    ("struct", r"^\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"),
    ("type", r"^\s+(\w+)(?:\[[^\]]*\])?\s+=?\s*[\w*\[(<]"),
)

IMPORT_RULES: list[ImportRule] = [
    ImportRule("go", r'^import\s+(?:[\w.]+\s+)?"([^"]+)"'), ImportRule("go", r'^\s*(?:[\w.]+\s+)?"([^"]+)"', "import"),
    ImportRule("javascript", r"""^\s*(?:import\b|\}).*?\bfrom\s*['"`]([^'"`]+)['"`]"""),
    ImportRule("javascript", r"""^\s*import\s*['"`]([^'"`]+)['"`]"""),
    ImportRule("typescript", r"""^\s*(?:import\b|\}).*?\bfrom\s*['"`]([^'"`]+)['"`]"""),
    ImportRule("typescript", r"""^\s*import\s*['"`]([^'"`]+)['"`]"""),
    ImportRule("rust", r"^\s*((?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+;?)"),
    ImportRule("java", r"^\s*(import\s+[^;]+;?)"), ImportRule("apex", r"^\s*(import\s+[^;]+;?)"), ImportRule("scala", r"^\s*(import\s+.+?)\s*$"),
    ImportRule("kotlin", r"^\s*(import\s+.+?)\s*$"),
    ImportRule("ruby", r"""^\s*(?:require|require_relative)[\s(]+['"]([^'"]+)['"]"""),
    ImportRule("c", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'), ImportRule("cpp", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'),
    ImportRule("elixir", r"^\s*(?:alias|import|use|require)\s+(.+?)\s*$"),
    ImportRule("protobuf", r"""^\s*import\s+(?:public\s+|weak\s+)?["']([^"']+)["']"""),
    ImportRule("dart", r"""^\s*(?:import|export)\s+['"]([^'"]+)['"]"""),
]
PYTHON_IMPORT = r"^\s*(?:import|from)\s+\S"

# A called name with its qualifiers right in front of an opening parenthesis, and the word before it.
CALL = (
    r"(?<![\w$])@?(?:[\w$>\]]+\s+)?(?:[A-Za-z_$][\w$]*(?:\?\.|\.|::|->))*[A-Za-z_$][\w$]*[?!]?"
    r"(?:<[\w:,\s*&]*>)?\s*\("
)
CALL_LEAD = r"^@?(?:([\w$>\]]+)\s+)?(?=[A-Za-z_$][^\s]*\s*\($)"
# After these words stands a definition or a construction, in any language.
DEFINING_LEAD = ("new", "func", "def", "defp", "defmacro", "defmacrop", "defguard", "fn", "fun", "function", "class")
# Languages that write a type in front of a declared name; there only these words precede a call.
TYPED = ("java", "apex", "c", "cpp", "dart")
CALL_LEAD_WORDS = ("", "return", "else", "throw", "case", "do", "await", "yield", "assert", "in", "is", "as", "and", "or", "not", "co_await", "co_return")
DECORATED_CALLS = ("python", "javascript", "typescript")
BANG_NAMES = ("ruby", "elixir")
GO_GROUP_OPEN = r"^(?:const|var|type|import)\s*\($"
# In these languages an interface lists members that look like calls.
INTERFACE_MEMBERS = ("go", "typescript")
# --- fixed values: words before a parenthesis that are no calls ----------------
NOT_CALLED = (
    "alias", "and", "assert", "async", "await", "case", "catch", "def", "defguard", "defimpl", "defmacro", "defmacrop", "defmodule",
    "defp", "defprotocol", "defstruct", "del", "do", "elif", "elsif", "else", "except", "fn", "for", "foreach", "func",
    "function", "Function", "guard", "if", "import", "in", "is", "lambda", "match", "not", "or", "raise", "require", "return", "select",
    "sizeof", "super", "switch", "synchronized", "this", "throw", "try", "typeof", "unless", "until", "use", "using", "when",
    "while", "with", "yield",
)

# Languages whose local variables are declared like fields.
LOCALS_LIKE_FIELDS = ("apex", "java")
LOCAL_HOLDERS = ("constructor", "function", "getter", "method", "setter")
