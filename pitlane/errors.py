"""Errors a caller may handle by kind."""


class PitlaneError(Exception):
    """Any expected failure; the command line ends with code 2 on it."""


class ConfigurationError(PitlaneError):
    pass


class DataContractError(PitlaneError):
    pass


class StrategyContractError(PitlaneError):
    pass


class InsufficientDataError(PitlaneError):
    pass


class SecurityBoundaryError(PitlaneError):
    pass
