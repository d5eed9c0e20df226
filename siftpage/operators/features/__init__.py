from siftpage.operators.features.assemble import (
    FEATURE_COLUMNS,
    features,
    prepare,
    text_features,
)

__all__ = ["FEATURE_COLUMNS", "features", "prepare", "text_features"]
