"""Fx12: source files put together from varied declaration shapes, and the rows each shape must give.

A file holds three different shapes, chosen and ordered by its key.  ``#``
stands for the file id.  Expected rows name lines from the start of the shape (from 0).
"""

from __future__ import annotations

# Each shape: text, then the rows it gives.
#   decls: line, end, kind, name, decl, doc, exported, receiver key
#   fields: line, owner, depth, path, name, type, tag, doc, exported, embedded, anonymous
#   specs: line, kind, name, exported      members: owner, what, pos, text
#   signatures: line, text                 bad (declarations), odd (members): line, message      tags: owner, has json / yaml    examples: owner, JSON; yaml: owner, YAML
SHAPES = [
    dict(text='''type (
	// GA# is first.
	GA# struct {
		X int `db:"x"` // see `y`
	}
	gb# int
	GC#[T []int] struct{}
)
''', decls=[(2, 4, "struct", "GA#", "type GA# struct", "GA# is first.", True, None), (5, 5, "type", "gb#", "type gb# int", "", False, None),
            (6, 6, "struct", "GC#", "type GC#[T []int] struct{}", "", True, None)],
         fields=[(3, "GA#", 0, "", "X", "int", 'db:"x"', "", True, False, False)], tags=[("GA#", False)],
         examples=[("GA#", '{\n  "X": 0\n}'), ("GC#", "{}")], yaml=[("GA#", "X: 0"), ("GC#", "{}")]),
    dict(text='''// Multi# has a header of some lines.
func Multi#(
	a int,
	b func(x, y int, z map[string]struct{}) error,
) (n int, err error) {
	return 0, nil
}

func get#() int { return f(1, 2) }
''', decls=[(1, 6, "func", "Multi#", "func Multi#(a int, b func(x, y int, z map[string]struct{}) error) (n int, err error)",
             "Multi# has a header of some lines.", True, None),
            (8, 8, "func", "get#", "func get#() int", "", False, None)],
         signatures=[(1, "func Multi#(a int, b func(x, y int, z map[string]struct{}) error) (n int, err error)"), (8, "func get#() int")]),
    dict(text='''var Raw# = `
type Fake# struct {
/* no comment, no block
`

var list# = []int{1,
	2,
}
''', decls=[(0, 3, "var", "Raw#", "var Raw# = `", "", True, None), (5, 7, "var", "list#", "var list# = []int{1,", "", False, None)],
         specs=[(0, "var", "Raw#", True), (5, "var", "list#", False)]),
    dict(text='''var M# = map[string]int{
	"a{": 1,
	alpha: 2,
}

const (
	a# = "http://x" // c
	B# = `q
r` +
		"s"
	c# = f(
		1,
	)
)
''', decls=[(0, 3, "var", "M#", "var M# = map[string]int", "", True, None), (5, 13, "const", "", "const", "", False, None)],
         specs=[(0, "var", "M#", True), (6, "const", "a#", False), (7, "const", "B#", True), (10, "const", "c#", False)]),
    dict(text='''type I# interface {
	io.Reader
	~int |
		~string
	// Do does.
	Do(
		a, b int,
	) error
	comparable
}

type H#[T any] func(T) error
''', decls=[(0, 9, "interface", "I#", "type I# interface", "", True, None),
            (11, 11, "functype", "H#", "type H#[T any] func(T) error", "", True, None)],
         members=[("I#", "term", 0, "io.Reader"), ("I#", "term", 1, "~int"), ("I#", "term", 2, "~string"), ("I#", "term", 3, "comparable"),
                  ("I#", "method", 0, "Do(a, b int) error")],
         signatures=[(5, "Do(a int, b int) error"), (11, "type H#[T any] func(T) error")]),
    dict(text='''// Deep# nests.
type Deep#[K comparable, V map[string][]int] struct {
	L1 struct {
		L2 struct {
			L3 struct {
				L4 struct {
					L5 struct {
						// Z is last.
						Z string `json:"z"`
					} `json:"l5"`
				}
			}
		}
	} `yaml:"l1"`
	io.Reader
}

type Empty# struct {
}
''', decls=[(1, 15, "struct", "Deep#", "type Deep#[K comparable, V map[string][]int] struct", "Deep# nests.", True, None),
            (17, 18, "struct", "Empty#", "type Empty# struct", "", True, None)],
         fields=[(2, "Deep#", 0, "", "L1", "struct", 'yaml:"l1"', "", True, False, True), (3, "Deep#", 1, "L1", "L2", "struct", "", "", True, False, True),
                 (4, "Deep#", 2, "L1.L2", "L3", "struct", "", "", True, False, True), (5, "Deep#", 3, "L1.L2.L3", "L4", "struct", "", "", True, False, True),
                 (6, "Deep#", 4, "L1.L2.L3.L4", "L5", "struct", 'json:"l5"', "", True, False, True),
                 (8, "Deep#", 5, "L1.L2.L3.L4.L5", "Z", "string", 'json:"z"', "Z is last.", True, False, False),
                 (14, "Deep#", 0, "", "", "io.Reader", "", "", True, True, False)], tags=[("Deep#", True)],
         yaml=[("Empty#", "{}"), ("Deep#", 'l1:\n  L2:\n    L3:\n      L4:\n        L5:\n          Z: "example"')],
         examples=[("Empty#", "{}"), ("Deep#", '''{
  "L1": {
    "L2": {
      "L3": {
        "L4": {
          "l5": {
            "z": "example"
          }
        }
      }
    }
  }
}''')]),
    dict(text='''func Gen#[K comparable, V any](m map[K]V, f func(a, b, c, d, e, g, h, i, j int), z string) chan int {
	if m == nil {
		return nil
	}
	return nil
}

// Push adds.
func (s *Stack#[T]) Push(v T) {
}
''', decls=[(0, 5, "func", "Gen#", "func Gen#[K comparable, V any](m map[K]V, f func(a, b, c, d, e, g, h, i, j int), z string) chan int", "", True, None),
            (8, 9, "method", "Push", "func (s *Stack#[T]) Push(v T)", "Push adds.", True, "Stack#")],
         signatures=[(0, "func Gen#[K comparable, V any](m map[K]V, f func(a, b, c, d, e, g, h, i, j int), z string) chan int"),
                     (8, "func (s *Stack#[T]) Push(v T)")]),
    dict(text='''func Broken#(a int) {
	if a > 0 {
}

type Slice# []struct {
	Q int
}
''', decls=[(4, 6, "type", "Slice#", "type Slice# []struct", "", True, None)], bad=[(0, "block not closed before the next declaration")]),
    # the same things on one line
    dict(text='''// One# is short.
type One# struct { A int; b, C string `json:"c"` }

type Two# interface { Get() int; Set(v int) error; ~int | ~string }

type None# struct{}
''', decls=[(1, 1, "struct", "One#", "type One# struct", "One# is short.", True, None), (3, 3, "interface", "Two#", "type Two# interface", "", True, None),
            (5, 5, "struct", "None#", "type None# struct{}", "", True, None)],
         fields=[(1, "One#", 0, "", "A", "int", "", "", True, False, False), (1, "One#", 0, "", "b", "string", 'json:"c"', "", False, False, False),
                 (1, "One#", 0, "", "C", "string", 'json:"c"', "", True, False, False)], tags=[("One#", True)],
         members=[("Two#", "method", 0, "Get() int"), ("Two#", "method", 1, "Set(v int) error"), ("Two#", "term", 0, "~int"), ("Two#", "term", 1, "~string")],
         signatures=[(3, "Get() int"), (3, "Set(v int) error")],
         examples=[("One#", '{\n  "A": 0,\n  "c": "example"\n}'), ("None#", "{}")], yaml=[("One#", 'A: 0\nC: "example"'), ("None#", "{}")]),
    # type params, a function type and a nested struct over several lines
    dict(text='''type Pair#[K comparable,
	V any,
] struct {
	F func(
		a int,
	) error `yaml:"f"`
	// G and H.
	G, H map[string]struct{ N int }
	M struct{ X, Y int; z bool } `json:"m"`
}
''', decls=[(0, 9, "struct", "Pair#", "type Pair#[K comparable, V any] struct", "", True, None)],
         fields=[(3, "Pair#", 0, "", "F", "func(\n\t\ta int,\n\t) error", 'yaml:"f"', "", True, False, False),
                 (7, "Pair#", 0, "", "G", "map[string]struct{ N int }", "", "G and H.", True, False, False),
                 (7, "Pair#", 0, "", "H", "map[string]struct{ N int }", "", "G and H.", True, False, False),
                 (8, "Pair#", 0, "", "M", "struct", 'json:"m"', "", True, False, True), (8, "Pair#", 1, "M", "X", "int", "", "", True, False, False),
                 (8, "Pair#", 1, "M", "Y", "int", "", "", True, False, False), (8, "Pair#", 1, "M", "z", "bool", "", "", False, False, False)],
         yaml=[("Pair#", "f: {}\nG: {}\nH: {}\nM:\n  X: 0\n  Y: 0")], tags=[("Pair#", True)], examples=[("Pair#", '{\n  "F": {},\n  "G": {},\n  "H": {},\n  "m": {\n    "X": 0,\n    "Y": 0\n  }\n}')]),
    # groups on one line, brackets inside a signature
    dict(text='''type (A# = int; B# struct { P *A# })

const (k# = 1; K2# = "a;b" /* c */)

// Do# does.
//
// Twice.
func (r Recv#) Do#(x struct{ A int }, y interface{ F() }) (z []int, err error) { return }

var v# = func() int {
	return 1
}()
''', decls=[(0, 0, "type", "A#", "type A# = int", "", True, None), (0, 0, "struct", "B#", "type B# struct", "", True, None), (2, 2, "const", "", "const", "", False, None),
            (7, 7, "method", "Do#", "func (r Recv#) Do#(x struct{ A int }, y interface{ F() }) (z []int, err error)", "Do# does.\n\nTwice.", True, "Recv#"),
            (9, 11, "var", "v#", "var v# = func() int", "", False, None)],
         fields=[(0, "B#", 0, "", "P", "*A#", "", "", True, False, False)], yaml=[("B#", "P: {}")], tags=[("B#", False)], examples=[("B#", '{\n  "P": {}\n}')],
         specs=[(2, "const", "k#", False), (2, "const", "K2#", True), (9, "var", "v#", False)],
         signatures=[(7, "func (r Recv#) Do#(x struct{ A int }, y interface{ F() }) (z []int, err error)")]),
    # what can't be read
    dict(text='''type Lost# struct {
	A int

func ok#() {
}

type ?# int

var Fine# int

type Odd# struct {
	+ int
	X int
}
''', decls=[(3, 4, "func", "ok#", "func ok#()", "", False, None), (8, 8, "var", "Fine#", "var Fine# int", "", True, None),
            (10, 13, "struct", "Odd#", "type Odd# struct", "", True, None)],
         bad=[(0, "block not closed before the next declaration"), (6, "declaration not recognised")], odd=[(11, "member not recognised")],
         fields=[(12, "Odd#", 0, "", "X", "int", "", "", True, False, False)], yaml=[("Odd#", "X: 0")], tags=[("Odd#", False)], examples=[("Odd#", '{\n  "X": 0\n}')],
         specs=[(8, "var", "Fine#", True)], signatures=[(3, "func ok#()")]),
]
SLOTS, STEP = 3, 3


def _text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def files_sql() -> str:
    """The files, in SQL that Spark and DuckDB read alike."""
    slot = " || chr(10) || ".join(
        f"CASE (p_partkey + {STEP * i}) % {len(SHAPES)} " + " ".join(f"WHEN {j} THEN {_text(s['text'])}" for j, s in enumerate(SHAPES)) + " END"
        for i in range(SLOTS))
    return f"SELECT p_partkey AS file_id, replace('package p#' || chr(10) || chr(10) || {slot}, '#', CAST(p_partkey AS STRING)) AS content FROM part"


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else _text(v)


def rows_sql(what: str, columns: str) -> str:
    """CTEs (DuckDB) that end in ``wanted``: the expected rows of kind ``what`` for every file, with the ``base`` line of their shape."""
    shapes = ", ".join(f"({j}, {s['text'].count(chr(10))})" for j, s in enumerate(SHAPES))
    rows = ", ".join("(" + ", ".join(map(_value, (j, *r))) + ")" for j, s in enumerate(SHAPES) for r in s.get(what, []))
    return f"""
, shape AS (SELECT * FROM (VALUES {shapes}) s(sid, n)),
slots AS (SELECT file_id, i, (file_id + {STEP} * i) % {len(SHAPES)} AS sid FROM fx12_files, range({SLOTS}) r(i)),
placed AS (SELECT file_id, sid, CAST(3 + coalesce(sum(n + 1) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base
       FROM slots JOIN shape USING (sid)),
want AS (SELECT * FROM (VALUES {rows}) w(sid, {columns})),
wanted AS (SELECT file_id, base, want.* FROM placed JOIN want USING (sid))
"""


# Fx13: declarations that refer to each other, to a module of Fx2 and to other packages.  In its rows # is the file id,
# @ the anchor of the file's own package and ~ a hash sign.
LINKS = dict(text='''import al "example.com/m1/p"
import "github.com/acme/lib"

// Owner# owns.
type Owner#[T any, U comparable] struct {
	Items map[string][]T `json:"items"`
	next *al.Item
	Fn func(x *Owner#) error
	N [Max]lib.Box[T, []al.Item]
	M map[al.Key]struct{ X Owner# }
}

type List#[E any] []E

func (o *Owner#[T, U]) Get(k U, w map[string]*Widget#, v ...T) (T, *al.Item)

func (l List#[E]) At(i int) E { return l[i] }

type Hook#[A any] func(A, chan<- lib.Event) error

type Face# interface { Do(ctx lib.Context, q unknown.Q) (n int, err error); Len() Owner# }

func New#[Z any](z Z) {}
''', owners=[(14, "Get", "struct", "T any, U comparable"), (16, "At", "type", "E any")],
    headings=[(5, "Items\tmap[string][]T"), (6, "next\t*<<example-com-m1-p-Item,al.Item>>"), (7, "Fn\tfunc(x *Owner#) error"),
              (8, "N\t[Max]link:https://pkg.go.dev/github.com/acme/lib~Box[lib.Box][T, []<<example-com-m1-p-Item,al.Item>>]"),
              (9, "M\tmap[<<example-com-m1-p-Key,al.Key>>]struct{ X Owner# }")],
    off=[(14, "func (o *Owner#[T, U]) Get(k U, w map[string]*Widget#, v ...T) (T, *al.Item)"), (16, "func (l List#[E]) At(i int) E"),
         (18, "type Hook#[A any] func(A, chan<- lib.Event) error"), (20, "Do(ctx lib.Context, q unknown.Q) (n int, err error)"), (20, "Len() Owner#"),
         (22, "func New#[Z any](z Z)")],
    internal=[(14, "func (o *<<@-Owner#,Owner#>>[T, U]) Get(k U, w map[string]*<<@-Widget#,Widget#>>, v ...T) (T, *<<example-com-m1-p-Item,al.Item>>)"),
              (16, "func (l <<@-List#,List#>>[E]) At(i int) E"), (18, "type Hook#[A any] func(A, chan<- lib.Event) error"),
              (20, "Do(ctx lib.Context, q unknown.Q) (n int, err error)"), (20, "Len() <<@-Owner#,Owner#>>"), (22, "func New#[Z any](z Z)")],
    external=[(14, "func (o *<<@-Owner#,Owner#>>[T, U]) Get(k U, w map[string]*<<@-Widget#,Widget#>>, v ...T) (T, *<<example-com-m1-p-Item,al.Item>>)"),
              (16, "func (l <<@-List#,List#>>[E]) At(i int) E"),
              (18, "type Hook#[A any] func(A, chan<- link:https://pkg.go.dev/github.com/acme/lib~Event[lib.Event]) error"),
              (20, "Do(ctx link:https://pkg.go.dev/github.com/acme/lib~Context[lib.Context], q unknown.Q) (n int, err error)"), (20, "Len() <<@-Owner#,Owner#>>"),
              (22, "func New#[Z any](z Z)")],
    separate=[(14, "func (o *<<@-Owner#,Owner#>>[T, U]) Get(k U, w map[string]*<<@-Widget#,Widget#>>, v ...T) (T, *link:m1.adoc~example-com-m1-p-Item[al.Item])"),
              (16, "func (l <<@-List#,List#>>[E]) At(i int) E"),
              (18, "type Hook#[A any] func(A, chan<- link:https://pkg.go.dev/github.com/acme/lib~Event[lib.Event]) error"),
              (20, "Do(ctx link:https://pkg.go.dev/github.com/acme/lib~Context[lib.Context], q unknown.Q) (n int, err error)"), (20, "Len() <<@-Owner#,Owner#>>"),
              (22, "func New#[Z any](z Z)")],
    markup=[(14, '<span class="hljs-function"><span class="hljs-keyword">func</span> <span class="hljs-params">(o *<a href="~@-Owner#">Owner#</a>[T, U]) </span>'
                 '<span class="hljs-title">Get</span><span class="hljs-params">(k U, w map[string]*<a href="~@-Widget#">Widget#</a>, v ...T)</span></span> '
                 '<span class="hljs-type">(T, *al.<a href="~example-com-m1-p-Item">Item</a>)</span>'),
            (16, '<span class="hljs-function"><span class="hljs-keyword">func</span> <span class="hljs-params">(l <a href="~@-List#">List#</a>[E]) </span>'
                 '<span class="hljs-title">At</span><span class="hljs-params">(i int)</span></span> <span class="hljs-type">E</span>'),
            (18, '<span class="hljs-keyword">type</span> <span class="hljs-title">Hook#[A any]</span> <span class="hljs-function"><span class="hljs-keyword">func</span>'
                 '<span class="hljs-params">(A, chan&lt;- lib.<a href="https://pkg.go.dev/github.com/acme/lib~Event">Event</a>)</span></span> <span class="hljs-type">error</span>'),
            (20, '<span class="hljs-function"><span class="hljs-title">Do</span><span class="hljs-params">(ctx lib.<a href="https://pkg.go.dev/github.com/acme/lib~Context">Context</a>, '
                 'q unknown.Q)</span></span> <span class="hljs-type">(n int, err error)</span>'),
            (20, '<span class="hljs-function"><span class="hljs-title">Len</span><span class="hljs-params">()</span></span> <span class="hljs-type"><a href="~@-Owner#">Owner#</a></span>'),
            (22, '<span class="hljs-function"><span class="hljs-keyword">func</span> <span class="hljs-title">New#[Z any]</span><span class="hljs-params">(z Z)</span></span>')])


def link_files_sql() -> str:
    return f"SELECT p_partkey AS file_id, replace('package p#' || chr(10) || chr(10) || {_text(LINKS['text'])}, '#', CAST(p_partkey AS STRING)) AS content FROM part"


def link_rows_sql(what: str, columns: str) -> str:
    """CTE (DuckDB) ``wanted``: the rows of kind ``what`` for every file of Fx13, signs replaced in the text column ``t``."""
    rows = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in LINKS[what])
    own = "'example-com-m' || CAST(file_id % 25 AS VARCHAR) || '-p'"
    return f"""
, want AS (SELECT * FROM (VALUES {rows}) w({columns})),
wanted AS (SELECT file_id, want.* REPLACE (CAST(l + 3 AS BIGINT) AS l, replace(replace(replace(t, '#', CAST(file_id AS VARCHAR)), '@', {own}), '~', '#') AS t) FROM fx13_files, want)
"""


# Fx14: packages of two files, and the document of a package (# the package's number, @ a hash sign).
PACKAGE = {"a": '''//go:build linux

// Package s# serves.
package s#

import "fmt"

// Service# greets with `fmt.Println` and `Conf#`.
type Service# struct {
	// Name is shown.
	Name string `json:"name"`
	Conf *Conf#
	hidden int
	Opts struct {
		On bool
	}
}

// Greet says hello.
func (s *Service#) Greet(to string) (n int, err error) {
	return fmt.Println(to)
}

func (s *Service#) quiet() {}

const (
	// Low# is first.
	Low# = iota + 1
	High#
	none#
)

// Default# serves all.
var Default# = &Service#{Name: "x"}
''', "b": '''// More about s#.
package s#

// Conf# holds values.
type Conf#[T any] map[string]T

// Form# formats.
type Form# interface {
	// Format makes text.
	Format(c Conf#[int]) string
	Len() int
	~int | ~string
}

// Hook# is called.
type Hook# func(*Service#) error

// New# makes one.
func New#(hooks ...Hook#) *Service# {
	return nil
}

func local#() {}
'''}
DOCUMENT = '''== Package example.com/m1/s#

[NOTE]
====
*Build Tags:* `linux`
====

Package s# serves.

More about s#.

== Imports

[source, go]
----
import "fmt"
----

== Interfaces

[[example-com-m1-s#-Form#]]

=== Form#
[source, go]
----
type Form# interface {
	~int | ~string
	Format(c Conf#[int])	string
	Len()	int
}
----

Form# formats.

==== Undocumented

[cols="1,1",options="header"]
|===
|Name |Signature
|`Len`|`Len() int`
|===

==== Format(c <<example-com-m1-s#-Conf#,Conf#>>[int]) string

Format makes text.

[source, go]
----
Format(c Conf#[int]) string
----

==== Type Set

* `~int`
* `~string`

== Structs

[[example-com-m1-s#-Service#]]

=== Service#
[source, go]
----
type Service# struct {
	Name	string
	Conf	*Conf#
	Opts	struct
}
----

Service# greets with link:https://pkg.go.dev/fmt@Println[fmt.Println] and <<example-com-m1-s#-Conf#,Conf#>>.

==== JSON Example
[source, json]
----
{
  "name": "example",
  "Conf": {},
  "Opts": {
    "On": false
  }
}
----

==== Undocumented

[cols="1,1,1",options="header"]
|===
|Field |Type |Tag
|`Conf`|`*Conf#`|
|===

==== Name string

Name is shown.

==== Receivers

===== Greet
[source, go]
----
func (s *Service#) Greet(to string) (n int, err error)
----
Greet says hello.

== Variable Typedefinitions

[[example-com-m1-s#-Conf#]]

=== Conf#[T any]
[source, go]
----
type Conf#[T any] map[string]T
----

Conf# holds values.

== Constants

[source, go]
----
const (
	Low#	= 1
	High#	= 2
)
----

=== Low#
[source, go]
----
Low# = 1
----
Low# is first.

=== High#
[source, go]
----
High# = 2
----

== Function Definitions

[[example-com-m1-s#-Hook#]]

=== Hook#
[source, go]
----
type Hook# func(*Service#) error
----

Hook# is called.

== Variables

=== Default#
[source, go]
----
var Default# = &Service#{Name: "x"}
----
Default# serves all.

== Functions

=== New#
[source, go]
----
func New#(hooks ...Hook#) *Service#
----

New# makes one.'''


def package_files_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT 'example.com/m1/s' || CAST(s_suppkey AS STRING) AS package, '/repo/m1/s' || CAST(s_suppkey AS STRING) || '/{name}.go' AS path, "
        f"replace({_text(text)}, '#', CAST(s_suppkey AS STRING)) AS content FROM supplier" for name, text in PACKAGE.items())


def package_lines_sql() -> str:
    """DuckDB: the lines of every package's document, ``package, line_no, text``."""
    return f"""
, docs AS (SELECT 'example.com/m1/s' || CAST(s_suppkey AS VARCHAR) AS package, string_split(replace(replace({_text(DOCUMENT)}, '#', CAST(s_suppkey AS VARCHAR)), '@', '#'), chr(10)) AS l FROM supplier)
, lines AS (SELECT package, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS line_no, unnest(l) AS text FROM docs)
"""
