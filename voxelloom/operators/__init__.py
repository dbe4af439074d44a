"""DataFrame operators over grids, images, samples, blocks, forests, scores and meshes."""
