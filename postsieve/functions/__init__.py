"""postsieve.functions"""
