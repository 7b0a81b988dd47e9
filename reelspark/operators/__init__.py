"""DataFrame operators on packets, frames, blocks, points and samples."""
