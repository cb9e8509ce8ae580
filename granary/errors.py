"""One exception class for each kind of failure the engine reports."""


class EngineError(Exception):
    """Base of every error the engine raises on purpose."""


class ParseError(EngineError):
    """The SQL text is outside the accepted grammar."""


class BindError(ParseError):
    """A name or a type does not resolve."""


class LoadError(ParseError):
    """Delimited input does not match its schema."""


class IoError(EngineError):
    """A file cannot be opened."""


class UnsupportedPlanError(EngineError):
    """The statement parses and binds, yet there is no operator for it."""
