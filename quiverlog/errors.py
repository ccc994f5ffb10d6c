"""Errors with their SQLSTATE."""


class EngineError(Exception):
    sqlstate = "XX000"


class ProgramSyntaxError(EngineError):
    sqlstate = "42601"


class ProgramLimitError(EngineError):
    sqlstate = "54000"


class InvalidParameterError(EngineError):
    sqlstate = "22023"


class DatatypeMismatchError(EngineError):
    sqlstate = "42804"


class PrivilegeError(EngineError):
    sqlstate = "42501"


class DataError(EngineError):
    sqlstate = "22000"


class NormalizerError(EngineError):
    sqlstate = "P0001"
