"""C++20 as a grammar of tokens for :mod:`codeloom.llm.derivatives`.

The grammar is ambiguous where the language needs names to decide; a text is
valid if any reading is.  Macros are not expanded: directives are taken out of
the token stream and must be known and balanced.  Every branch of a conditional
group is read, but for those under a literal 0: the text is valid if each of as
many texts as it takes to read them all is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from codeloom.llm.derivatives import Grammar, Tokens

BAD = "BAD"

RULES = r"""
unit: declaration*
declaration: ';' | namespace | using | template | linkage | 'asm' '(' STRING ')' ';' | static_assert | function | constructor | simple_declaration | export
export: 'export' declaration | 'export' '{' declaration* '}' | ['export'] 'module' [ID ('.' ID)*] ';' | ['export'] 'import' (ID ('.' ID)* | STRING) ';'
namespace: ['inline'] 'namespace' attributes [['inline'] ID ('::' ['inline'] id)*] attributes '{' declaration* '}' | 'namespace' id '=' ['::'] id ('::' id)* ';'
using: 'using' 'namespace' ['::'] id ('::' id)* ';' | 'using' ['typename'] qualified (',' ['typename'] qualified)* ';' | 'using' id attributes '=' type_id ';' | 'using' 'enum' qualified ';'
template: 'template' '<' [template_params] '>' [requires] (template | function | constructor | simple_declaration | using | concept | friend_template) | 'template' simple_declaration | 'extern' 'template' simple_declaration
friend_template: 'friend' (function | simple_declaration)
concept: 'concept' id '=' expr_no_comma ';'
requires: 'requires' requires_or
requires_or: requires_primary (('&&' | '||') requires_primary)*
requires_primary: qualified | '(' expr ')' | 'true' | 'false' | requires_expr
template_params: template_param (',' template_param)*
template_param: ('typename' | 'class') ['...'] [id] ['=' type_id] | 'template' '<' [template_params] '>' ('typename' | 'class') ['...'] [id] ['=' qualified] | specs_typed declarator_abstract ['=' operand_no_greater] | qualified ['...'] id ['=' type_id]
linkage: 'extern' STRING ('{' declaration* '}' | declaration)
static_assert: 'static_assert' '(' expr_no_comma [',' STRING+] ')' ';'
simple_declaration: attributes specs_typed [init_declarators] ';'
function: attributes specs_typed pointer* declarator_function function_tail function_body
constructor: attributes spec_plain* constructor_name parameters function_tail (function_body | ':' member_inits compound | ';' | '=' '0' ';')
constructor_name: [qualified_head] (id | '~' id | 'operator' type_id) | qualified
function_body: compound | 'try' compound handler+ | '=' ('default' | 'delete') ';'
member_inits: member_init (',' member_init)*
member_init: qualified ('(' [arguments] ')' | braces) ['...']
function_tail: (CV | '&' | '&&' | noexcept | 'throw' '(' [type_ids] ')' | 'override' | 'final' | attribute | '->' type_id)* [requires]
noexcept: 'noexcept' ['(' expr ')']
declarator_function: declarator_id parameters | '(' pointer+ declarator_id parameters ')' parameters
declarator_id: ['...'] qualified_declarator
qualified_declarator: qualified | operator_id | qualified_head operator_id | qualified_head '~' id
operator_id: 'operator' operator_name
operator_name: OPERATOR | '+' | '-' | '*' | '&' | '&&' | '||' | '<' ['<'] ['='] | '>' ['>'] ['='] | '<' '=' '>' | '=' | ',' | '->' | '~' | '!' | '(' ')' | '[' ']' | ('new' | 'delete') ['[' ']'] | STRING id | 'co_await' | '++' | '--' | '->*' | '==' | '!='
parameters: '(' [parameter (',' parameter)* [[','] '...'] | '...'] ')'
parameter: attributes ['this'] specs_typed declarator_abstract ['=' initializer]
declarator_abstract: pointer* ['...'] [id attributes | '(' pointer* [id] ')' | '(' qualified_head pointer [id] ')'] (parameters (CV | '&' | '&&' | noexcept)* | '[' [expr] ']')* 
pointer: ('*' | '&' | '&&' | qualified_head '*') (CV | attribute)*
init_declarators: init_declarator (',' init_declarator)*
init_declarator: pointer* declarator ['=' initializer | '(' arguments ')' | braces | ':' expr_no_comma ['=' initializer] | '=' '0' | '=' ('default' | 'delete')]
declarator: declarator_id attributes (parameters function_tail | '[' [expr] ']')* | '(' pointer* declarator ')' (parameters function_tail | '[' [expr] ']')* | '[' id (',' id)* ']' | '(' qualified_head pointer declarator ')' parameters function_tail | ':' expr_no_comma
initializer: assignment | braces
specs_typed: (spec_plain | attribute)* typed (spec_plain | attribute)*
typed: builtin+ (CV | builtin)* | ['typename'] qualified ['auto'] | ('class' | 'struct' | 'union' | 'enum' | 'enum' 'class') attributes qualified | class_specifier | enum_specifier | 'auto' | 'decltype' '(' expr ')' ('::' id)* 
spec_plain: SPECIFIER | CV | 'inline' | 'extern' | 'friend' | 'typedef' | 'constexpr' | 'explicit' '(' expr ')' | 'explicit' | 'alignas' '(' expr_or_type ')'
builtin: BUILTIN
class_specifier: ('class' | 'struct' | 'union') attributes [qualified ['final']] [':' base (',' base)*] '{' member* '}'
base: attributes (ACCESS | 'virtual')* ['typename'] qualified ['...']
member: ACCESS ':' | ';' | using | template | static_assert | function | constructor | simple_declaration | 'friend' qualified ';'
enum_specifier: 'enum' ['class' | 'struct'] attributes [qualified] [':' specs_typed] '{' [enumerator (',' enumerator)* [',']] '}'
enumerator: id attributes ['=' expr_no_comma]
attributes: attribute*
attribute: '[' '[' [attribute_item (',' [attribute_item])*] ']' ']' | '__attribute__' '(' '(' balanced* ')' ')'
attribute_item: any_id ['::' any_id] ['(' balanced* ')'] ['...']
any_id: id | 'const' | 'noreturn'
balanced: '(' balanced* ')' | '[' balanced* ']' | '{' balanced* '}' | ID | NUMBER | STRING | CHAR | ',' | '::' | '.' | '=' | '==' | '+' | '-' | '*' | '<' | '>' | '&' | '|' | ':' | 'true' | 'false' | BUILTIN | CV
compound: '{' statement* '}'
statement: attributes statement_body
statement_body: compound | ';' | expr ';' | if | 'switch' '(' condition_init ')' statement | 'while' '(' condition ')' statement | 'do' statement 'while' '(' expr ')' ';' | for | 'break' ';' | 'continue' ';' | 'return' [expr | braces] ';' | 'goto' id ';' | id ':' statement | 'case' expr_no_comma ['...' expr_no_comma] ':' statement_or_end | 'default' ':' statement_or_end | try | local_declaration | 'co_return' [expr | braces] ';' | 'co_yield' (expr | braces) ';'
statement_or_end: [statement]
local_declaration: simple_declaration | using | static_assert | 'namespace' id '=' qualified ';' | 'asm' '(' STRING ')' ';'
if: 'if' ['constexpr'] '(' condition_init ')' statement ['else' statement] | 'if' ['!'] 'consteval' compound ['else' statement]
condition_init: [simple_declaration | expr ';' | ';' | using] condition
condition: expr | specs_typed pointer* declarator_id ('=' initializer | braces) | specs_typed pointer* '[' id (',' id)* ']' ('=' initializer | braces)
for: 'for' '(' (simple_declaration | [expr] ';') [condition] ';' [expr] ')' statement | 'for' 'co_await' '(' range ')' statement | 'for' '(' [simple_declaration | expr ';'] range ')' statement
range: attributes specs_typed pointer* (id | '[' id (',' id)* ']') ':' (expr | braces)
try: 'try' compound handler+
handler: 'catch' '(' ('...' | attributes specs_typed declarator_abstract) ')' compound
expr: assignment (',' assignment)*
expr_no_comma: assignment
expr_or_type: expr | type_id
assignment: operand tail* | 'throw' [operand tail*] | 'co_yield' (assignment | braces)
tail: binary operand | '?' expr ':' assignment | ASSIGN (assignment | braces) | '=' (assignment | braces)
binary: BINARY | '+' | '-' | '*' | '/' | '&' | '&&' | '||' | '|' | '<' ['<'] | '>' ['>'] | '<' '=' | '>' '=' | '==' | '!=' | '<' '=' '>' | '.*' | '->*'
operand: prefix* postfix
operand_no_greater: prefix* postfix (('+' | '-' | '*' | '/' | '&' | '&&' | '||' | '|' | '==' | '!=' | BINARY | '<') prefix* postfix)*
prefix: '++' | '--' | '+' | '-' | '!' | '~' | '*' | '&' | '&&' | '(' type_id ')' | 'co_await' | 'sizeof' | 'alignof' | ['::'] 'delete' ['[' ']']
postfix: primary (call | '[' [arguments] ']' | ('.' | '->') ['template'] (qualified | '~' id | operator_id) | '++' | '--' | braces | '...')*
call: '(' [arguments] ')'
arguments: argument (',' argument)*
argument: (assignment | braces) ['...']
primary: NUMBER | STRING+ | CHAR | 'true' | 'false' | 'nullptr' | 'this' | qualified_declarator | '(' expr ')' | '(' fold ')' | lambda | BUILTIN+ (call | braces) | 'typename' qualified (call | braces) | CAST '<' type_id '>' '(' expr ')' | ('sizeof' | 'alignof' | 'typeid' | 'noexcept' | 'decltype') '(' expr_or_type ')' | 'sizeof' '...' '(' id ')' | new | requires_expr | 'auto' (call | braces) | '{' '}'
fold: operand fold_op '...' [fold_op operand] | '...' fold_op operand
fold_op: binary | ',' | ASSIGN | '='
new: ['::'] 'new' ['(' arguments ')'] (specs_typed pointer* ('[' expr ']')* | '(' type_id ')') [call | braces]
requires_expr: 'requires' [parameters] '{' requirement+ '}'
requirement: expr ';' | 'typename' qualified ';' | '{' expr '}' ['noexcept'] ['->' qualified] ';' | 'requires' expr ';'
lambda: '[' [captures] ']' ['<' template_params '>' [requires]] attributes [parameters lambda_tail] compound
lambda_tail: ('mutable' | 'constexpr' | 'static' | SPECIFIER | noexcept | attribute | '->' type_id)* [requires]
captures: capture (',' capture)*
capture: '=' | '&' | ['&'] ['...'] id ['...'] ['=' initializer | '(' arguments ')' | braces] | ['*'] 'this'
braces: '{' [brace_item (',' brace_item)* [',']] '}'
brace_item: (assignment | braces) ['...'] | '.' id ('=' initializer | braces)
type_id: specs_typed declarator_type
type_ids: type_id ['...'] (',' type_id ['...'])*
declarator_type: pointer* ['(' pointer+ ')' | '(' qualified_head pointer ')'] (parameters (CV | '&' | '&&' | noexcept | '->' type_id)* | '[' [expr] ']')*
qualified: ['::'] template_name ('::' ['template'] template_name)* | 'decltype' '(' expr ')' '::' template_name
qualified_head: ['::'] (template_name '::')+
template_name: id ['<' [template_args] '>']
template_args: template_arg (',' template_arg)*
template_arg: (type_id | operand_no_greater | '(' expr ')') ['...']
id: ID | 'override' | 'final' | 'import' | 'module'
"""

_KEYWORDS = frozenset(
    """alignas alignof asm auto break case catch class co_await co_return co_yield concept consteval const_cast continue decltype default delete do
    else enum explicit export extern false final for friend goto if import inline module mutable namespace new noexcept nullptr operator override
    requires return sizeof static static_assert struct switch template this throw true try typedef typeid typename union using virtual while constexpr
    __attribute__""".split()
)
_CLASSES = {
    **dict.fromkeys("public private protected".split(), "ACCESS"),
    **dict.fromkeys("const volatile".split(), "CV"),
    **dict.fromkeys("int long short char bool float double void unsigned signed wchar_t char8_t char16_t char32_t".split(), "BUILTIN"),
    **dict.fromkeys("static_cast dynamic_cast const_cast reinterpret_cast".split(), "CAST"),
    **dict.fromkeys("static virtual mutable register thread_local constinit consteval".split(), "SPECIFIER"),
    **dict.fromkeys("+= -= *= /= %= ^= &= |=".split(), "ASSIGN"),
    **dict.fromkeys("% ^".split(), "BINARY"),
    "and": "&&", "or": "||", "not": "!", "bitand": "&", "bitor": "|", "xor": "BINARY", "compl": "~", "not_eq": "!=", "and_eq": "ASSIGN", "or_eq": "ASSIGN", "xor_eq": "ASSIGN",
}
_DIRECTIVES = frozenset("include define undef if ifdef ifndef elif elifdef elifndef else endif line error warning pragma import".split())
_LEX = re.compile(
    r"""(?sm)(?P<directive>^[ \t]*\#(?:\\\n|/\*.*?\*/|[^\n])*)|(?P<space>(?:[ \t\f\v]*\n)+|[ \t\f\v]+|\\\n)|(?P<comment>//(?:\\\n|[^\n])*|/\*.*?\*/)
    |(?P<raw>(?:u8|[uUL])?R"(?P<delimiter>[^()\\\s]{0,16})\(.*?\)(?P=delimiter)")
    |(?P<cut>/\*|(?:u8|[uUL])?R"[^()\\\s]{0,16}(?:\(|\Z)|(?:u8|[uUL])?(?:"(?:\\.|[^"\\\n])*\\?\Z|'(?:\\.|[^'\\\n])*\\?\Z))
    |(?P<string>(?:u8|[uUL])?"(?:\\.|[^"\\\n])*")|(?P<char>(?:u8|[uUL])?'(?:\\.|[^'\\\n])+')
    |(?P<number>\.?[0-9](?:'?[A-Za-z0-9_.]|(?<=[eEpP])[+-])*)|(?P<word>[^\W\d]\w*)
    |(?P<punct>\.\.\.|->\*|->|\+\+|--|::|&&|\|\||[-+*/%^&|=!]=|\.\*|[-+*/%^&|~!=<>?:;,.()\[\]{}])""",
    re.X,
)
_COMMENT = re.compile(r"(?s)/\*.*?\*/|//.*")
_INCLUDE = re.compile(r'<[^>\n]+>|"[^"\n]+"|[A-Za-z_]\w*(?:\(.*\))?')
_NUMBER = re.compile(
    r"(?:0[xX](?:[0-9a-fA-F]+(?:'[0-9a-fA-F]+)*)?(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?[0-9]+)?|0[bB][01]+(?:'[01]+)*"
    r"|(?:[0-9]+(?:'[0-9]+)*)?\.?[0-9]*(?:'[0-9]+)*(?:[eE][+-]?[0-9]+)?)"
    r"(?:[uUlLzZfF]{0,3}|_\w+|h|min|s|ms|us|ns|i|il|if|sv|y|d)"
)
_OCTAL = re.compile(r"0[0-9']*[89]")
_ESCAPE = re.compile(r"\\(?![0-7'\"?\\abfnrtve\n]|x[0-9a-fA-F]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|u\{|N\{|o\{|x\{)")


def grammar() -> Grammar:
    return Grammar(RULES, "unit")


@dataclass
class _Branch:
    """A run of text within a conditional group: spans of tokens and groups, and how many readings it takes."""

    items: list = field(default_factory=list)
    start: int = 0
    dead: bool = False
    n: int = 1


@dataclass
class _Group:
    """Branches that exclude one another.  The one where nothing is defined is the first reading, so that
    groups under the same condition agree; ``taken``: a literal 1 leaves nothing to the branches behind."""

    negated: bool
    taken: bool = False
    closed: bool = False
    branches: list[_Branch] = field(default_factory=list)
    n: int = 1

    def finish(self) -> None:
        if not self.closed and not self.taken:
            self.branches.append(_Branch())
        live = [b for b in self.branches if not b.dead]
        if not (self.negated and len(live) == 2):
            live = live[-1:] + live[:-1]
        self.branches, self.n = live, sum(b.n for b in live)


_ZERO, _ONE = ("0", "false"), ("1", "true")


def _spans(top: _Branch, k: int) -> list[tuple[int, int]]:
    """The spans of the ``k``-th reading in order."""
    out, stack = [], [(top, k)]
    while stack:
        item, k = stack.pop()
        if isinstance(item, tuple):
            out.append(item)
        elif isinstance(item, _Branch):
            stack.extend((x, k) for x in reversed(item.items))
        else:
            k = min(k, item.n - 1)
            for branch in item.branches:
                if k < branch.n:
                    stack.append((branch, k))
                    break
                k -= branch.n
    return out


def tokens(text: str) -> Tokens:
    """Token classes of a translation unit; what no token can be made of ends them with ``BAD``."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        return Tokens([BAD])
    out: list[str] = []
    branch, stack, cut, some = _Branch(), [], False, False
    at, end, match, dead = 0, len(text), _LEX.match, False

    def leave() -> None:
        """End the branch that is being read."""
        branch.items.append((branch.start, len(out)))
        branch.n = max([x.n for x in branch.items if isinstance(x, _Group)] + [1])

    while at < end:
        m = match(text, at)
        if m is None:
            if dead:
                at = text.find("\n", at) + 1 or end
                continue
            out.append(BAD)
            break
        kind, value = m.lastgroup, m[0]
        if kind == "cut":
            if dead and not value.endswith("*"):
                at = text.find("\n", at) + 1 or end
                continue
            cut = True
            break
        at = m.end()
        if kind == "space" or kind == "comment":
            continue
        if kind == "directive":
            rest = _COMMENT.sub(" ", value.replace("\\\n", " ")).strip()[1:].strip()
            word = re.match(r"[A-Za-z_]*", rest)[0]
            condition = rest[len(word) :].strip()
            if word in ("if", "ifdef", "ifndef"):
                some = True
                leave()
                group = _Group(word == "ifndef" or condition.startswith("!"))
                stack.append((branch, group, dead))
                branch = _Branch(start=len(out), dead=dead or (word == "if" and condition in _ZERO))
                group.taken, dead = word == "if" and condition in _ONE, branch.dead
            elif word.startswith("el") or word == "endif":
                if not stack or (stack[-1][1].closed and word != "endif"):
                    out.append(BAD)
                    break
                leave()
                outer, group, was_dead = stack[-1]
                group.branches.append(branch)
                if word == "endif":
                    stack.pop()
                    group.finish()
                    outer.items.append(group)
                    branch, dead = outer, was_dead
                    branch.start = len(out)
                else:
                    group.closed = word == "else"
                    branch = _Branch(start=len(out), dead=was_dead or group.taken or (word == "elif" and condition in _ZERO))
                    group.taken, dead = group.taken or (word == "elif" and condition in _ONE), branch.dead
            elif not dead and ((rest and word not in _DIRECTIVES) or (word == "include" and not _INCLUDE.fullmatch(condition))):
                out.append(BAD)
                break
        elif dead:
            continue
        elif kind == "word":
            out.append(_CLASSES.get(value) or (value if value in _KEYWORDS else "ID"))
        elif kind == "punct":
            out.append(_CLASSES.get(value, value))
        elif kind == "number":
            if not _NUMBER.fullmatch(value) or _OCTAL.fullmatch(value.rstrip("uUlLzZ")):
                out.append(BAD)
                break
            out.append("NUMBER")
        elif kind == "char":
            out.append("CHAR" if not _ESCAPE.search(value) else BAD)
        else:
            out.append("STRING" if kind in ("raw", "delimiter") or not _ESCAPE.search(value) else BAD)
    if not some:
        return Tokens(out, None, cut)
    cut |= bool(stack) and out[-1:] != [BAD]
    leave()
    while stack:
        outer, group, _ = stack.pop()
        group.branches.append(branch)
        group.closed = True
        group.finish()
        outer.items.append(group)
        branch, branch.start = outer, len(out)
        leave()
    return Tokens(out, None, cut, [_spans(branch, k) for k in range(branch.n)])
