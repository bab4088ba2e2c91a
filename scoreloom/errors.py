"""What the operators raise when an input breaks its contract."""


class ContractError(ValueError):
    """A table does not hold what its schema promises."""


class ConfigError(ValueError):
    """An argument is out of its domain."""
