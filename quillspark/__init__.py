"""quillspark — corpus documentation analytics as Spark DataFrame operators.

A corpus of source files (path + text) is a table.  The operators in this
package filter it by path rules, split it into lines and declarations, resolve
references between them with equi-joins, and assemble ordered documentation
text — all as lazy DataFrame plans that Catalyst optimises.

Sub-packages
------------
sources    corpus scans, manifest scans, document sinks
functions  Column-expression helpers (glob compile, text helpers)
operators  filters, extraction, joins, aggregations, windows, user functions
plans      rendering of sections / indexes and end-to-end documentation plans
streaming  incremental corpus walk on Structured Streaming
"""

__version__ = "0.1.0"
