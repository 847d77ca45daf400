"""Code units from source text, file by file, inside the JVM.

A file is one row, so everything between the scan and the unit rows is narrow: text
is blanked (strings, comments), lines are numbered, and one regular expression per
kind of unit captures whole blocks from every start position. Repetitions in the
patterns are possessive, which the JVM's matcher runs as loops rather than by
recursion. Spans follow the text, not a grammar; the limits are listed in the README.
"""
