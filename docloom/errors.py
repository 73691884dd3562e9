"""Errors that users see."""


class RecipeError(ValueError):
    """A recipe document that isn't valid."""


class OperationError(ValueError):
    """A step whose configuration can't be compiled."""


class ExpressionError(ValueError):
    """A jq or JSONata expression beyond the supported forms."""


class PatchError(ValueError):
    """A JSON Patch that doesn't apply."""
