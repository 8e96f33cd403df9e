"""The dialect's syntax: statement and expression nodes, and the parser."""
