"""The two errors a caller may want to tell apart."""


class ConfigError(ValueError):
    """Settings that cannot give a meaningful run."""


class DataError(ValueError):
    """An input that is missing, empty or lacks columns."""
