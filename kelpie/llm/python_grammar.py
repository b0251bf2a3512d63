"""The grammar of logical lines of Python 3, over canonical tokens.

Tokens: a (identifier), the soft keywords as they are, 1 (number), 1j (imaginary number), s (string), b (bytes), f< and f>
(around an f-string, of which only the fields are left), {f and }f (around a field), :f (before a format), keywords and
operators as they are. A logical line is one or more simple statements, or the head of a compound one with what follows on
its line; how lines form blocks is not said here.
"""

from __future__ import annotations

import functools

from kelpie.llm import grammar

TEXT = """
line: head ':' [simple_line] | '@' named | simple_line
case_line: 'case' patterns ['if' named] ':' [simple_line]
match_line: 'match' subject ':'
simple_line: simple (';' simple)* [';']
head: 'if' named | 'elif' named | 'else' | 'while' named | 'try' | 'finally' | except_head | ['async'] 'for' targets 'in' star_exprs | ['async'] with_head | ['async'] def_head | class_head
except_head: 'except' '*' expr ['as' name] | 'except' [expr ['as' name]]
with_head: 'with' '(' with_item (',' with_item)* [','] ')' &':' | 'with' with_item (',' with_item)*
with_item: expr 'as' star_target &(',' | ')' | ':') | expr
def_head: 'def' name [type_params] '(' [params] ')' ['->' expr]
class_head: 'class' name [type_params] ['(' [arguments] ')']
type_params: '[' type_param (',' type_param)* [','] ']'
type_param: '*' name ['=' star_expr] | '**' name ['=' expr] | name [':' expr] ['=' expr]
simple: assignment | type_alias | star_exprs | 'return' [star_exprs] | import_name | import_from | 'raise' [expr ['from' expr]] | 'pass' | 'break' | 'continue' | 'del' del_targets &(';' | end) | yield_expr | 'assert' expr [',' expr] | ('global' | 'nonlocal') name (',' name)*
end: !any
any: 'a' | 'match' | 'case' | 'type' | '_' | '1' | '1j' | 's' | 'b' | 'f<' | '(' | ')' | '[' | ']' | '{' | '}' | ',' | ':' | '.' | '=' | '+' | '-' | '*' | '**' | '/' | '//' | '%' | '@' | 'if' | 'for' | 'in' | 'is' | 'and' | 'or' | 'not' | 'as' | 'else' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '|' | '&' | '^' | '~' | '<<' | '>>' | ':=' | '...' | 'lambda' | 'await' | 'yield' | 'from' | 'import' | 'None' | 'True' | 'False' | 'async' | '->' | '!' | augmented
type_alias: 'type' name [type_params] '=' expr
import_name: 'import' dotted_as (',' dotted_as)*
dotted_as: dotted ['as' name]
dotted: name ('.' name)*
import_from: 'from' ('.' | '...')* dotted 'import' imported | 'from' ('.' | '...')+ 'import' imported
imported: '(' import_as (',' import_as)* [','] ')' | import_as (',' import_as)* !',' | '*'
import_as: name ['as' name]
name: 'a' | 'match' | 'case' | 'type' | '_'
assignment: (t_trail | name | '(' single ')') ':' expr ['=' rhs] | (targets '=')+ rhs !'=' | single augmented rhs
augmented: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**='
rhs: yield_expr | star_exprs
single: t_trail | name !trailer | '(' single ')'
targets: star_target (',' star_target)* [',']
star_target: '*' target | target
target: t_trail | name !trailer | '(' target ')' !trailer | '(' [target_tuple] ')' !trailer | '[' [targets] ']' !trailer
target_tuple: star_target (',' star_target)+ [','] | star_target ','
t_trail: atom (call* (attribute | subscript))+ !trailer
del_targets: del_target (',' del_target)* [',']
del_target: t_trail | name !trailer | '(' [del_targets] ')' !trailer | '[' [del_targets] ']' !trailer
yield_expr: 'yield' 'from' expr | 'yield' [star_exprs]
star_exprs: star_expr (',' star_expr)* [',']
star_expr: '*' arithmetic | expr
star_nameds: star_named (',' star_named)* [',']
star_named: '*' arithmetic | named
named: name ':=' expr | expr !':='
expr: lambdef | either ('if' either 'else' either)* ['if' either 'else' lambdef]
either: inversion (('and' | 'or') inversion)*
inversion: 'not'* comparison
comparison: arithmetic (compared arithmetic)*
compared: '==' | '!=' | '<=' | '<' | '>=' | '>' | 'not' 'in' | 'in' | 'is' 'not' | 'is'
arithmetic: operand (('+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '^' | '|') operand)*
operand: ('+' | '-' | '~')* ['await'] primary
primary: atom trailer*
trailer: attribute | call | subscript
attribute: '.' name
call: '(' generator ')' | '(' [arguments] ')'
subscript: '[' slices ']'
slices: (slice | '*' arithmetic) (',' (slice | '*' arithmetic))* [',']
slice: [expr] ':' [expr] [':' [expr]] | named
atom: name | 'True' | 'False' | 'None' | '...' | '1' | '1j' | strings | bracketed
strings: ('s' | fstring)+ | 'b'+
fstring: 'f<' field* 'f>'
field: '{f' rhs ['='] ['!' name] [':f' field*] '}f'
bracketed: '(' generator ')' | '(' yield_expr ')' | '(' named ')' | '(' [star_named ',' [star_nameds]] ')' | '[' named comprehension ']' | '[' [star_nameds] ']' | '{' named comprehension '}' | '{' expr ':' expr comprehension '}' | '{' [pair (',' pair)* [',']] '}' | '{' star_nameds '}'
pair: '**' arithmetic | expr ':' expr
generator: named comprehension
comprehension: (['async'] 'for' targets 'in' either ('if' either)*)+
arguments: positional (',' positional)* [',' keywords] [','] | keywords [',']
positional: '*' expr | name ':=' expr | expr !':=' !'='
keywords: keyword_star (',' keyword_star)* (',' keyword_double)* | keyword_double (',' keyword_double)*
keyword_star: name '=' expr | '*' expr
keyword_double: name '=' expr | '**' expr
lambdef: 'lambda' [l_params] ':' expr
params: p_head [',' p_star] [','] | p_star [',']
p_head: p_plain (',' p_plain)* ',' '/' [',' p_plain (',' p_plain)*] [',' p_default (',' p_default)*] | p_plain (',' p_plain)* ',' p_default (',' p_default)* ',' '/' [',' p_default (',' p_default)*] | p_plain (',' p_plain)* [',' p_default (',' p_default)*] | p_default (',' p_default)* ',' '/' [',' p_default (',' p_default)*] | p_default (',' p_default)*
p_plain: name [':' expr] !'='
p_default: name [':' expr] '=' expr
p_star: '*' name [':' star_expr] !'=' (',' p_only)* [',' '**' p_plain] | '*' ',' p_only (',' p_only)* [',' '**' p_plain] | '**' p_plain
p_only: name [':' expr] ['=' expr]
l_params: l_head [',' l_star] [','] | l_star [',']
l_head: l_plain (',' l_plain)* ',' '/' [',' l_plain (',' l_plain)*] [',' l_default (',' l_default)*] | l_plain (',' l_plain)* ',' l_default (',' l_default)* ',' '/' [',' l_default (',' l_default)*] | l_plain (',' l_plain)* [',' l_default (',' l_default)*] | l_default (',' l_default)* ',' '/' [',' l_default (',' l_default)*] | l_default (',' l_default)*
l_plain: name !'='
l_default: name '=' expr
l_star: '*' l_plain (',' l_only)* [',' '**' l_plain] | '*' ',' l_only (',' l_only)* [',' '**' l_plain] | '**' l_plain
l_only: name ['=' expr]
subject: star_named ',' [star_nameds] | named
patterns: maybe_star ',' [maybe_star (',' maybe_star)* [',']] | pattern
maybe_star: '*' name | pattern
pattern: either_pattern ['as' captured]
captured: 'a' | 'match' | 'case' | 'type'
either_pattern: closed ('|' closed)*
closed: class_pattern | literal | dotted !('.' | '(' | '=') | '(' pattern ')' | '[' [maybe_star (',' maybe_star)* [',']] ']' | '(' [maybe_star ',' [maybe_star (',' maybe_star)* [',']]] ')' | mapping
literal: ['-'] ('1' ('+' | '-') '1j' | ('1' | '1j') !('+' | '-')) | 's'+ | 'b'+ | 'None' | 'True' | 'False'
class_pattern: dotted '(' [class_args [',']] ')'
class_args: pattern !'=' (',' pattern !'=')* [',' class_keyword (',' class_keyword)*] | class_keyword (',' class_keyword)*
class_keyword: name '=' pattern
mapping: '{' '}' | '{' '**' captured [','] '}' | '{' map_item (',' map_item)* [',' '**' captured] [','] '}'
map_item: (literal | name ('.' name)+) ':' pattern
"""


@functools.cache
def rules() -> dict:
    return grammar.parse(TEXT)


@functools.cache
def recogniser() -> grammar.Recogniser:
    return grammar.Recogniser(rules())


@functools.cache
def permitted() -> frozenset[tuple[str, str]]:
    return frozenset(grammar.pairs(rules(), ["line", "case_line", "match_line"]))


def is_line(tokens: list[str]) -> bool:
    """Whether the tokens are a logical line outside a match block."""
    r = recogniser()
    return r.derives("line", tokens) or tokens[0] == "match" and r.derives("match_line", tokens)


def is_case(tokens: list[str]) -> bool:
    return tokens[0] == "case" and recogniser().derives("case_line", tokens)
