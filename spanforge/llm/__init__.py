"""Operators for training text: conversations, packing, token ids, mixtures and subjects. Nothing outside imports this folder."""
