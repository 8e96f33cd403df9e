"""The public names in one place."""

from .engine import Documents, Outcome, Records, Result, Tables, execute
from .plans.nodes import Program
from .plans.parser import ParseError, parse_expression, parse_program, parse_query
from .render import RENDERERS, comma_separated, footer, full, markdown, renderer, simple
from .session import local_session
from .sources.documents import Options
from .sources.headers import Document, HeaderError
from .sources.headers import parse as parse_document
from .sources.headers import render as render_document
from .sources.languages import SyntaxChoiceError
from .sources.languages import chosen as choose_syntax
from .sources.listing import SourceError
from .sources.stores import Store
from .streaming import over_stream

__all__ = [
    "Document", "Documents", "HeaderError", "Options", "Outcome", "ParseError", "Program", "RENDERERS", "Records", "Result", "SourceError", "Store", "SyntaxChoiceError", "Tables",
    "choose_syntax", "comma_separated", "execute", "footer", "full", "local_session", "markdown", "over_stream", "parse_document", "parse_expression", "parse_program", "parse_query",
    "render_document", "renderer", "simple",
]
