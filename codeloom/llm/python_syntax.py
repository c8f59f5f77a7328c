"""Python 3.12+ as a grammar of tokens for :mod:`codeloom.llm.derivatives`.

The rules restate the published language reference without left recursion;
operator precedence is kept only where it decides validity.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import token as T
import tokenize
import warnings

from codeloom.llm.derivatives import Grammar, Tokens

BAD = "BAD"
SOFT = frozenset({"match", "case", "type", "_"})
KEYWORDS = frozenset(keyword.kwlist)

RULES = r"""
file: (NEWLINE | statement)* 
statement: compound | simple
simple: small (';' small)* [';'] NEWLINE
small: assignment | star_exprs | 'return' [star_exprs] | import | raise | 'pass' | del | yield | assert | 'break' | 'continue' | ('global' | 'nonlocal') name (',' name)* | 'type' name [type_params] '=' expr
block: NEWLINE INDENT statement+ DEDENT | simple
compound: decorators (function | class) | function | class | if | while | for | with | try | match
decorators: ('@' named NEWLINE)+
function: ['async'] 'def' name [type_params] '(' [params] ')' ['->' expr] ':' block
class: 'class' name [type_params] ['(' [arguments] ')'] ':' block
if: 'if' named ':' block ('elif' named ':' block)* [else]
else: 'else' ':' block
while: 'while' named ':' block [else]
for: ['async'] 'for' star_targets 'in' star_exprs ':' block [else]
with: ['async'] 'with' (with_item (',' with_item)* | '(' with_item (',' with_item)* [','] ')') ':' block
with_item: expr ['as' star_target]
try: 'try' ':' block (finally | except+ [else] [finally] | except_star+ [else] [finally])
finally: 'finally' ':' block
except: 'except' [expr ['as' name]] ':' block
except_star: 'except' '*' expr ['as' name] ':' block
match: 'match' subject ':' NEWLINE INDENT case_block+ DEDENT
subject: star_named ',' [star_nameds] | named
case_block: 'case' patterns ['if' named] ':' block
patterns: open_sequence | pattern
open_sequence: maybe_star ',' [maybe_star (',' maybe_star)* [',']]
maybe_star: '*' name | pattern
pattern: or_pattern ['as' name]
or_pattern: closed ('|' closed)*
closed: number_pattern | strings | 'None' | 'True' | 'False' | name | name ('.' name)+ | '(' pattern ')' | '[' [maybe_star (',' maybe_star)* [',']] ']' | '(' [open_sequence] ')' | '{' [map_items] '}' | name ('.' name)* '(' [class_items] ')'
number_pattern: ['-'] NUMBER [('+' | '-') NUMBER]
map_items: map_item (',' map_item)* [','] | (map_item ',')* '**' name [',']
map_item: (number_pattern | strings | 'None' | 'True' | 'False' | name ('.' name)+) ':' pattern
class_items: pattern (',' pattern)* (',' name '=' pattern)* [','] | name '=' pattern (',' name '=' pattern)* [',']
import: 'import' dotted ['as' name] (',' dotted ['as' name])* | 'from' ('.' | '...')* dotted 'import' imported | 'from' ('.' | '...')+ 'import' imported
dotted: name ('.' name)*
imported: '*' | import_as (',' import_as)* | '(' import_as (',' import_as)* [','] ')'
import_as: name ['as' name]
raise: 'raise' [expr ['from' expr]]
assert: 'assert' expr [',' expr]
del: 'del' del_target (',' del_target)* [',']
del_target: name | reached | '(' [del_target (',' del_target)* [',']] ')' | '[' [del_target (',' del_target)* [',']] ']'
yield: 'yield' ('from' expr | [star_exprs])
assignment: name ':' expr ['=' value] | ('(' single ')' | reached) ':' expr ['=' value] | (star_targets '=')+ value | single AUGMENTED value
value: yield | star_exprs
single: name | reached | '(' single ')'
reached: atom trailer* ('.' name | '[' slices ']')
star_targets: star_target (',' star_target)* [',']
star_target: '*' target | target
target: reached | name | '(' target ')' | '(' [star_target ',' [star_target (',' star_target)* [',']]] ')' | '[' [star_target (',' star_target)* [',']] ']'
star_exprs: star_expr (',' star_expr)* [',']
star_expr: '*' sum | expr
star_nameds: star_named (',' star_named)* [',']
star_named: '*' sum | named
named: name ':=' expr | expr
expr: disjunction ['if' disjunction 'else' expr] | lambda
lambda: 'lambda' [lambda_params] ':' expr
disjunction: conjunction ('or' conjunction)*
conjunction: inversion ('and' inversion)*
inversion: 'not'* comparison
comparison: sum (comparator sum)*
comparator: COMPARE | 'in' | 'not' 'in' | 'is' ['not']
sum: unary ((BINARY | '/' | '*' | '**' | '+' | '-' | '|' | '@') unary)*
unary: ('+' | '-' | '~')* ['await'] primary
primary: atom trailer*
trailer: '.' name | '(' [arguments] ')' | '(' named comprehension ')' | '[' slices ']'
atom: name | NUMBER | 'None' | 'True' | 'False' | '...' | strings | '(' inside_parens ')' | '[' inside_brackets ']' | '{' inside_braces '}'
inside_parens: [star_named ',' [star_nameds]] | yield | named | named comprehension
inside_brackets: [star_nameds] | named comprehension
inside_braces: [dict_item (',' dict_item)* [',']] | star_nameds | named comprehension | expr ':' expr comprehension
dict_item: '**' sum | expr ':' expr
comprehension: (['async'] 'for' star_targets 'in' disjunction ('if' disjunction)*)+
slices: slice | (slice | '*' sum) (',' (slice | '*' sum))* [',']
slice: [expr] ':' [expr] [':' [expr]] | named
arguments: positional (',' positional)* [',' keywords] [','] | keywords [',']
positional: '*' expr | named
keywords: plain_keyword (',' plain_keyword)* (',' last_keyword)* | last_keyword (',' last_keyword)*
plain_keyword: name '=' expr | '*' expr
last_keyword: name '=' expr | '**' expr
strings: (STRING | fstring)+ | BYTES+
fstring: FSTRING_START (FSTRING_MIDDLE | field)* FSTRING_END
field: '{' (yield | star_exprs) ['='] ['!' name] [':' (FSTRING_MIDDLE | field)*] '}'
type_params: '[' type_param (',' type_param)* [','] ']'
type_param: name [':' expr] ['=' expr] | '*' name ['=' star_expr] | '**' name ['=' expr]
params: plain params_a | given params_b | params_star
params_a: [',' [plain params_a | given params_b | '/' params_c | params_star]]
params_c: [',' [plain params_c | given params_d | params_star]]
params_b: [',' [given params_b | '/' params_d | params_star]]
params_d: [',' [given params_d | params_star]]
params_star: '*' (plain | name ':' '*' sum) params_e | '*' ',' (plain | given) params_e | '**' plain [',']
params_e: [',' [(plain | given) params_e | '**' plain [',']]]
plain: name [':' expr]
given: name [':' expr] '=' expr
lambda_params: name lambda_a | name '=' expr lambda_b | lambda_star
lambda_a: [',' [name lambda_a | name '=' expr lambda_b | '/' lambda_c | lambda_star]]
lambda_c: [',' [name lambda_c | name '=' expr lambda_d | lambda_star]]
lambda_b: [',' [name '=' expr lambda_b | '/' lambda_d | lambda_star]]
lambda_d: [',' [name '=' expr lambda_d | lambda_star]]
lambda_star: '*' name lambda_e | '*' ',' name ['=' expr] lambda_e | '**' name [',']
lambda_e: [',' [name ['=' expr] lambda_e | '**' name [',']]]
name: NAME | 'match' | 'case' | 'type' | '_'
"""

_AUGMENTED = {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}
_COMPARE = {"<", ">", "==", ">=", "<=", "!="}
_BINARY = {"//", "%", "&", "^", "<<", ">>"}
_OPERATORS = {**dict.fromkeys(_AUGMENTED, "AUGMENTED"), **dict.fromkeys(_COMPARE, "COMPARE"), **dict.fromkeys(_BINARY, "BINARY")}
_ESCAPED = re.compile(r"\\[xuUN]")


def grammar() -> Grammar:
    return Grammar(RULES, "file")


def _string(text: str) -> str:
    quote = min(i for i in (text.find("'"), text.find('"')) if i >= 0)
    prefix = text[:quote].lower()
    if "b" in prefix and not text.isascii():
        return BAD
    if "r" not in prefix and _ESCAPED.search(text):
        try:
            ast.literal_eval(text)
        except (SyntaxError, ValueError):
            return BAD
    return "BYTES" if "b" in prefix else "STRING"


def _breaks_off(error: Exception, text: str) -> bool:
    """Whether the tokenizer met the end of the text within a bracket, a string or a line to be continued."""
    if not isinstance(error, tokenize.TokenError):
        return False
    message, (line, _) = error.args
    if "EOF" in message or "triple-quoted" in message:
        return True
    return "unterminated" in message and line > text.count("\n")


def tokens(text: str) -> Tokens:
    """Token classes of a module; what no token can be made of ends them with ``BAD``.

    The end of the text adds the tokens that close a line and its blocks; they are not of the text itself.
    """
    out: list[str] = []
    if "\0" in text:
        return Tokens([BAD])
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    end, cut = 0, False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            conversion = False
            for kind, value, *_ in tokenize.generate_tokens(io.StringIO(text).readline):
                if kind == T.NAME:
                    if conversion and value not in ("r", "s", "a"):
                        out.append(BAD)
                        break
                    out.append(value if value in KEYWORDS or value in SOFT else "NAME" if value.isidentifier() else BAD)
                elif kind == T.OP:
                    out.append(_OPERATORS.get(value, value))
                elif kind in (T.NL, T.COMMENT, T.ENDMARKER):
                    continue
                elif kind == T.STRING:
                    out.append(_string(value))
                else:
                    out.append(BAD if kind == T.ERRORTOKEN else T.tok_name[kind])
                conversion = kind == T.OP and value == "!"
                if value:
                    end = len(out)
            else:
                return Tokens(out, end)
    except (tokenize.TokenError, SyntaxError, ValueError) as error:
        cut = _breaks_off(error, text)
        if not cut:
            out.append(BAD)
    return Tokens(out, None, cut)
