"""postsieve.streaming"""
