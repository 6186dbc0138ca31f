"""postsieve.operators"""
