"""The tables the engine works on. One row per pixel, scribble point or seed; images are told apart by image_id."""

IMAGES = "image_id string, n_rows int, n_cols int, n_channels int, norm int"
PIXELS = "image_id string, x int, y int, idx long, val array<int>"
SCRIBBLES = "image_id string, marker_id int, ord int, x int, y int, is_object boolean"
LABELS = "image_id string, idx long, x int, y int, label int, tree_id int, cost double, border int"
SEEDS = "image_id string, seed_ord int, idx long, label int, tree_id int, is_root boolean"

OBJECT, BACKGROUND = 1, 2

#: Neighbour offsets (dx, dy) in the order in which ties are broken.
FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = (*FOUR, (-1, 1), (1, -1), (-1, -1), (1, 1))
