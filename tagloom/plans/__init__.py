"""The ten user commands, composed from the operators."""
