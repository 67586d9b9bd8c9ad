from hashgrove.functions.maps import map_merge, map_union_strict
from hashgrove.functions.sizes import row_size, size_estimate
from hashgrove.functions.text import (
    browser_class,
    category_default,
    clean_name,
    device_class,
    dotted_tail,
    filled,
    first_filled,
    hex_shard,
    os_class,
    path_label,
)

__all__ = [
    "browser_class",
    "category_default",
    "clean_name",
    "device_class",
    "dotted_tail",
    "filled",
    "first_filled",
    "hex_shard",
    "map_merge",
    "map_union_strict",
    "os_class",
    "path_label",
    "row_size",
    "size_estimate",
]
