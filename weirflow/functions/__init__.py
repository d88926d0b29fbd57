from .callables import each_row, fold_global, fold_groups, per_group
from .expressions import aggregate, extreme_range, word_list

__all__ = ["aggregate", "each_row", "extreme_range", "fold_global", "fold_groups", "per_group", "word_list"]
