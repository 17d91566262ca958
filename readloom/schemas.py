"""Schemas of the records: alignments, SV reads, signatures, masks."""

from __future__ import annotations

SEQUENCE = "id long, name string, comment string, seq string, qual string"
#: Text order of an alignment line.
ALIGNMENT = "qname string, sname string, ident double, score int, qdir int, qoff long, qend long, qsize long, sdir int, soff long, send long, ssize long"
MASK = "name string, from long, to long"
SV_READ = "qid long, qdir int, qoff long, qend long, qsize long, sid long, soff long, send long, dist int"
SIGNATURE = "qid long, qdir int, qfrom long, qto long, fqfrom long, fqto long, qsize long, sfrom long, sto long, fsfrom long, fsto long, ssize long, type int"
# Fixed values of the record formats.
FWD, REV = 0, 1
DELETION, INSERTION = 0, 6
