"""postsieve.plans"""
