"""Tables: explicit schemas, no inference.  Integers are 64-bit; unsigned 64-bit labels keep their bits."""

VOLUMES = "volume_id long, sx long, sy long, sz long, ax double, ay double, az double"
VOXELS = "volume_id long, vid long, x long, y long, z long, label long"
GRAPH_VOXELS = f"{VOXELS}, graph_bits long"
BLOCKS = "volume_id long, ox long, oy long, oz long, sx long, sy long, sz long, dtype string, data binary"
TARGETS = "volume_id long, kind string, ord long, x long, y long, z long"
VERTICES = "volume_id long, label long, vidx long, x float, y float, z float, radius float"
EDGES = "volume_id long, label long, e0 long, e1 long"
QUERIES = "qid long, label long, cx double, cy double, cz double, tag long"
#: One row a skeleton: what the grouped kernels return before it is split into vertices and edges.
SKELETONS = "volume_id long, label long, part long, vertices array<struct<x: float, y: float, z: float, radius: float>>, edges array<struct<e0: long, e1: long>>"
